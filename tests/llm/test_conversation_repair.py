"""Conversation repair against plain versions: every edit sequence for short conversations, a table of best prefixes for long ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from factloom.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, digest string, copies string, piece string"
INITIAL = {"user": "u", "assistant": "a"}


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        out[conv] += []
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    for members in out.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Best (cost, audit, repaired) of each prefix and state; equal prefixes of one cost never continue one another, so the least audit is kept."""
    new = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, turns) in list(best.items()):
                role = {"u": "user", "a": "assistant"}[new[state]]
                other = (cost + 5, audit + "I", turns + [f"{role}:"])
                if new[state] not in best or other[:2] < best[new[state]][:2]:
                    best[new[state]] = other
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, found):
        after, extra = {}, 5 * (fault == "truncated")
        for state, (cost, audit, turns) in best.items():
            ways = [(state, 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                x = role[:1]
                if (x == "s" and state == "") or (x == "u" and state != "u") or (x == "a" and state == "u"):
                    ways.append((x, extra, "K", [f"{role}:{text}"]))
                ways.append((new[state], 1 + extra, "R", [("user:" if new[state] == "u" else "assistant:") + text]))
            for to, c, letter, line in ways:
                other = (cost + c, audit + letter, turns + line)
                if to not in after or other[:2] < after[to][:2]:
                    after[to] = other
        best = inserted(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def plain(rows):
    out = []
    for conv, members in damage(rows).items():
        found = faults(members)
        cost, audit, turns = cheapest(members, found)
        numbers = {t for t, _, _ in members if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(members, members[1:]))
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def given(seed, conversations=120, longest=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage", "umpire"]
    texts = ["Yes.", "No!", "Well", "Cut off in", "Done. \n", "Why?\t", " ", "", None, "Ünïcode. ", "x" * 50 + "."]
    for conv in range(conversations):
        weights = rng.choice([[5, 5, 5, 5, 2, 0, 0, 0, 0, 0], [1] * 10])
        for turn in range(rng.randint(1, longest)):
            yield conv if conv else None, rng.choice([turn, turn, turn, turn * 2, None, 3]), rng.choices(roles, weights)[0], rng.choice(texts) if rng.random() < 0.7 else f"t{rng.random()}."


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_equals_the_plain_version(spark, parts):
    rows = list(given(int(parts)))
    docs = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(map(tuple, repair.repair_report(repair.damaged(docs)).collect()), key=key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(plain(rows), key=key)


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "", f"{t}.", f"{t}", f"{t}!"])) for t in range(600)] + [(8, 1, "user", "Hi."), (9, 3, "assistant", "Yes.")]
    rows += [(10, 5, "user", "again.")] * 300
    docs = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        turns = repair.damaged(docs)
        got = sorted(map(tuple, repair.repair_report(turns).collect()), key=key)
        lines = defaultdict(list)
        for r in repair.repaired_turns(turns).orderBy("conv_id", "seq").collect():
            lines[r.conv_id].append(f"{r.role}:{r.text}")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(plain(rows), key=key)
    assert {r[0]: r[-1] for r in got} == {c: hashlib.sha256("\n".join(lines[c]).encode()).hexdigest() for c in (7, 8, 9, 10)}


def test_every_edit_sequence_of_short_conversations():
    """The walk against all sequences with up to three insertions at each place."""
    pattern = re.compile("(s?(ua)+)?")
    rng = random.Random(5)
    for _ in range(150):
        rows = [(0, rng.choice(["user", "assistant", "system", "other"]), rng.choice(["a.", "b", "", "c!"])) for _ in range(rng.randint(0, 3))]
        found = faults(rows)
        best = None
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, found)):
                continue
            for inserts in itertools.product(range(4), repeat=len(rows) + 1):
                audit = "I" * inserts[0] + "".join(e + "I" * n for e, n in zip(edits, inserts[1:]))
                cost = 5 * sum(inserts) + sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (e != "D" and f == "truncated") for e, f in zip(edits, found))
                if best and (cost, audit) >= best:
                    continue
                given = iter(zip(edits, rows))
                options = [""]
                for letter in audit:
                    role = "" if letter == "I" else next(given)[1][1][:1]
                    options = [o + x for o in options for x in ({"D": [""], "K": [role]}.get(letter) or ["u", "a"])]
                if any(pattern.fullmatch(o) for o in options):
                    best = (cost, audit)
        facts = [(1, 0, role, b"", 1, f == "blank", f == "duplicate", f == "truncated") for (_, role, _), f in zip(rows, found)]
        assert cheapest(rows, found)[:2] == best
        if facts:
            piece = repair.Piece(facts)
            steps, _ = piece.walk(repair.distances(piece.free, repair.GOAL), repair.GOAL, 0)
            assert "".join("I" * len(b) + e + "I" * len(a) for b, e, _, a in steps) == best[1]


def test_empty_and_lost(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(repair.damaged(docs)).count() == 0
    assert repair.repaired_turns(repair.damaged(docs)).count() == 0
    lost = next((c, 0, "user", "x.") for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair_report(repair.damaged(spark.createDataFrame([(*lost, "", "", "")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(lost[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_texts(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "x" * 2_000_000), (1, 2, "user", " " * 1_000_000 + "end." + " " * 1_000_000), (1, 2, "user", None)]
    docs = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    assert [tuple(r) for r in repair.repair_report(repair.damaged(docs)).collect()] == plain(rows)
