"""Repair of conversations whose turns were lost, doubled, emptied, cut or given to the wrong speaker: the cheapest edits that make the roles alternate.

A conversation is a line of rows; a node is (rows passed, state of the role pattern `(s?(ua)+)?`), an arc an edit: Keep, Rerole, Delete, Insert, all of costs 0 to 6. Dial's
bucket queue runs backwards from the accepting ends and records each node's distance; from the start, the walk then takes the tight arc with the least initial, which gives the
least audit in ASCII order of all cheapest ones (an audit determines the states that it passes, so no two arcs of a node share an initial). Rows that must go (blank, seen before)
are no nodes: they cost the same on every path, and as D sorts before I they are deleted before anything is inserted at their place.

Nothing but a hash is made of texts until the edits are known: equal rows of a turn are one row with a number of copies, and rows are sorted by range, so that a conversation of any length lies in
pieces over many tasks. Conversations inside a task are solved there. A piece at a task's end gives a 4 x 4 matrix (state before, state after, distance); the driver
composes these, two for each task at most, to each piece's distances behind it. Each piece then walks from each state, and a second composition tells which walk counts.

Edge cases. Nulls are one space. Rows of one turn go by role, then by the SHA-256 of their text (null turns first); equal rows of a turn are copies of one row, all but
the first of them duplicates. A null conv_id is a conversation of its own. A conversation of which no row is left has zeros and the empty audit. An empty table gives an empty
result; other columns are ignored, whatever their names. Texts of any length are taken whole. The report's hash over a whole conversation can only be taken in order: there one task streams a conversation's rows, and holds one row and the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, durable

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
FAR = 1 << 60
#: States of the pattern: nothing yet, after system, after user, after assistant; the last one and the first accept.
GOAL = [0, FAR, FAR, 0]
#: A new user or assistant turn: the state after it, by the state before.
NEW = [2, 2, 3, 2]
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
BEFORE = [[s for s in range(4) if NEW[s] == t] for t in range(4)]
EDITS = "conv_id long, turn long, role string, digest binary, copies long, blank boolean, later boolean, truncated boolean, piece long, entry int, before string, edit string, new_role string, after string, leaves int, matrix array<long>"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), *[pa.bool_()] * 3, pa.int64(), pa.int32(), *[pa.string()] * 4, pa.int32(), pa.list_(pa.int64())]
_NAMES = [x.split()[0] for x in EDITS.split(", ")]
_FACTS = _NAMES[:8]


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row that is kept, if it may be."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


_KEPT = {x: [kept_state(s, x) for s in range(4)] for x in "sua"} | {"": [None] * 4}
_KEPT_BEFORE = {x: [[s for s in range(4) if to[s] == t] for t in range(4)] for x, to in _KEPT.items()}


def distances(rows: list[tuple[str, bool]], goal: list[int]) -> list[list[int]]:
    """Distance of every node (rows passed, state) to the goals behind the last row, by a bucket queue. rows: initial (s, u, a or empty), truncated."""
    n, least = len(rows), min(goal)
    far = [[FAR] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(max(g for g in goal if g < FAR) - least + REROLE + CUT_OFF + 1)]
    width = len(buckets)
    waiting = 0
    for s, g in enumerate(goal):
        if g < FAR:
            far[n][s] = g
            buckets[(g - least) % width].append((n, s))
            waiting += 1
    d = least
    while waiting:
        bucket = buckets[(d - least) % width]
        while bucket:
            i, t = bucket.pop()
            waiting -= 1
            if far[i][t] != d:
                continue
            arcs = [(i, s, d + INSERT) for s in BEFORE[t]]
            if i:
                initial, cut = rows[i - 1]
                more = d + CUT_OFF * cut
                arcs.append((i - 1, t, d + DELETE))
                arcs += [(i - 1, s, more + KEEP) for s in _KEPT_BEFORE[initial][t]]
                arcs += [(i - 1, s, more + REROLE) for s in BEFORE[t]]
            for j, s, x in arcs:
                if x < far[j][s]:
                    far[j][s] = x
                    buckets[(x - least) % width].append((j, s))
                    waiting += 1
        d += 1
    return far


class Piece:
    """Consecutive rows (in the columns of _FACTS) of one conversation."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.free = [(r[2][:1] if r[2][:1] in _KEPT else "", r[7]) for r in rows if self.is_free(r)]

    @staticmethod
    def is_free(r: tuple) -> bool:
        return r[4] > 0 and not r[5] and not r[6]

    def matrix(self) -> list[int]:
        """Distances from each state before to each state after, by rows."""
        columns = [distances(self.free, [0 if s == t else FAR for s in range(4)])[0] for t in range(4)]
        return [columns[t][s] for s in range(4) for t in range(4)]

    def walk(self, far: list[list[int]], goal: list[int], state: int) -> tuple[list[tuple], int]:
        """(before, edit, new_role, after) of each row along the tight arcs from a state, and the state behind. Copies of a row are deleted after it."""
        out, i = [], 0
        for r in self.rows:
            before, edit, new_role = "", "", None
            if self.is_free(r):
                initial, cut = self.free[i]
                while True:
                    here, kept = far[i][state], _KEPT[initial][state]
                    if DELETE + far[i + 1][state] == here:
                        edit = "D"
                    elif INSERT + far[i][NEW[state]] == here:
                        before, state = before + ROLE[NEW[state]][0], NEW[state]
                        continue
                    elif kept is not None and KEEP + CUT_OFF * cut + far[i + 1][kept] == here:
                        edit, state = "K", kept
                    else:
                        edit, state = "R", NEW[state]
                        new_role = ROLE[state]
                    break
                i += 1
            elif r[4]:
                edit = "D"
            out.append((before, edit, new_role, ""))
        after = ""
        while far[i][state] != goal[state]:
            after, state = after + ROLE[NEW[state]][0], NEW[state]
        if after:
            out[-1] = (*out[-1][:3], after)
        return out, state


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names=_NAMES)


def _solved(rows: list[tuple]) -> list[tuple]:
    piece = Piece(rows)
    edits, _ = piece.walk(distances(piece.free, GOAL), GOAL, 0)
    return [(*r, None, None, *e, None, None) for r, e in zip(rows, edits)]


def _inside(it: Iterator[tuple[int, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Solves the conversations inside a task; what touches its ends is a piece: its rows, and one more row with its matrix."""

    def piece(rows, number):
        return [(*r, number, *[None] * 7) for r in rows] + [(rows[0][0], *[None] * 7, number, *[None] * 6, Piece(rows).matrix())]

    part, runs, run, out = 0, 0, [], []
    for batch in it:
        columns = [column_of(batch, n).to_pylist() for n in (*_FACTS, "part")]
        for *row, part in zip(*columns):
            if run and run[-1][0] != row[0]:
                out += _solved(run) if runs else piece(run, 2 * part)
                runs, run = runs + 1, []
                if len(out) > 5000:
                    yield _batch(out)
                    out = []
            run.append(tuple(row))
    if run:
        out += piece(run, 2 * part + (runs > 0))
    yield _batch(out)


def _through(goals: dict[int, list[int]], heads: set[int]):
    """Walks of each piece, from the start or from every state; one more row for each walk tells the state that it leaves."""

    def run(it):
        def walked(rows):
            number, piece = rows[0][8], Piece([r[:8] for r in rows])
            goal = goals[number]
            far = distances(piece.free, goal)
            for entry in (0,) if number in heads else range(4):
                edits, leaves = piece.walk(far, goal, entry)
                yield _batch([(*r[:8], number, entry, *e, None, None) for r, e in zip(rows, edits)] + [(rows[0][0], *[None] * 7, number, entry, *[None] * 4, leaves, None)])

        rows = []
        for batch in it:
            for row in zip(*(column_of(batch, n).to_pylist() for n in _NAMES)):
                if rows and rows[-1][8] != row[8]:
                    yield from walked(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from walked(rows)

    return run


# -- rows of the conversations -------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as their crc32(`conv_id:turn`) mod 20 damages them; copies is 0 for dropped and 2 for repeated rows."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _digest(text) -> F.Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def edits(turns: DataFrame) -> DataFrame:
    """An edit for each distinct row of turns (conv_id, turn, role, text, copies): roles of the turns inserted before it, Keep, Rerole (to new_role) or Delete of its first
    copy, and roles of the turns inserted after it. Other copies are deleted; a row without copies has no edit."""
    spark = turns.sparkSession
    text = F.col("text")
    facts = turns.select("conv_id", "turn", "role", _digest(text).alias("digest"), "copies", (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"))
    facts = durable(facts.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")), "turns")
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = facts.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    later = facts.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    facts = later.select("conv_id", "turn", "role", "digest", "copies", "blank", F.coalesce(place > F.col("first"), F.lit(False)).alias("later"), "truncated")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "digest"]
    facts = facts.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    solved = durable(facts.mapInArrow(_inside, EDITS), "edits")
    inside = solved.where("piece is null")
    # Two matrices a task at most. Pieces follow one another in the order of their numbers; those of one conversation make a chain.
    pieces = [(r.piece, r.conv_id, r.matrix) for r in solved.where("matrix is not null").select("piece", "conv_id", "matrix").orderBy("piece").collect()]
    heads = {p for (p, conv, _), before in zip(pieces, [(None, object(), None), *pieces]) if conv != before[1]}
    goals, goal = {}, GOAL
    for (p, _, matrix), after in zip(reversed(pieces), [None, *reversed(pieces)]):
        goal = GOAL if after is None or after[0] in heads else goal
        goals[p] = goal
        goal = [min(FAR, *(matrix[4 * s + t] + goal[t] for t in range(4))) for s in range(4)]
    undecided = solved.where("piece is not null and matrix is null").repartition("piece").sortWithinPartitions("piece", *order[1:])
    walks = durable(undecided.mapInArrow(_through(goals, heads), EDITS), "walks")
    leaves = {(r.piece, r.entry): r.leaves for r in walks.where("leaves is not null").select("piece", "entry", "leaves").collect()}
    chosen, state = [], 0
    for p, _, _ in pieces:
        state = 0 if p in heads else state
        chosen.append((p, state))
        state = leaves[p, state]
    chosen = spark.createDataFrame(chosen, "piece long, entry int")
    return inside.unionByName(walks.where("leaves is null").join(F.broadcast(chosen), ["piece", "entry"], "left_semi")).select(*_FACTS, "before", "edit", "new_role", "after")


def _met(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Edits, each followed by the texts of its row."""
    texts = turns.where("copies > 0").select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), F.lit(1).alias("kind"), "text")
    return found.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)


_ORDER = ["conv_id", "turn", "role", "digest", "kind"]


def _script(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(edit row as a dict, repaired turns) of sorted rows of _met; a turn is (edit, role, text)."""
    names = (*_FACTS, "kind", "before", "edit", "new_role", "after", "text")
    edit, made, wanted = None, [], False
    for batch in it:
        for values in zip(*(column_of(batch, n).to_pylist() for n in names)):
            row = dict(zip(names, values))
            if row["kind"]:
                if wanted:
                    made.append((edit["edit"], edit["new_role"] or edit["role"], row["text"]))
                    wanted = False
                continue
            if edit:
                yield edit, made + [("I", ROLE[2 + (x == "a")], "") for x in edit["after"]]
            edit, made, wanted = row, [("I", ROLE[2 + (x == "a")], "") for x in row["before"]], row["edit"] in ("K", "R")
    if edit:
        yield edit, made + [("I", ROLE[2 + (x == "a")], "") for x in edit["after"]]


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, seq, edit, role, text), seq ascending inside a conversation. Conversations of any length are dealt over many tasks by range."""
    schema = pa.schema([("conv_id", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(it):
        for edit, made in _script(it):
            if made:
                yield pa.RecordBatch.from_pylist([{"conv_id": edit["conv_id"], "edit": e, "role": r, "text": t} for e, r, t in made], schema)

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _met(turns, durable(edits(turns), "chosen")).repartitionByRange(parts, *_ORDER[:4]).sortWithinPartitions(*_ORDER)
    out = met.mapInArrow(run, "conv_id long, edit string, role string, text string")
    return out.select("conv_id", F.monotonically_increasing_id().alias("seq"), "edit", "role", "text")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Report:
    def __init__(self, conv_id):
        self.conv_id, self.counts, self.audit, self.hash, self.turns, self.distinct, self.ends = conv_id, [0] * 5, [], hashlib.sha256(), 0, 0, None
        self.last = None

    def add(self, row: dict, made: list[tuple]) -> None:
        copies, initial = row["copies"], row["role"][:1]
        if copies:
            cut = not row["blank"] and not row["later"] and row["truncated"]
            for k, x in enumerate((copies * row["blank"], 0 if row["blank"] else copies - 1 + row["later"], int(cut), copies - 1)):
                self.counts[k] += x
            self.counts[3] += self.last is not None and self.last + initial not in LEGAL
            self.last = initial
            if row["turn"] is not None and (self.ends is None or self.ends[1] != row["turn"]):
                self.distinct += 1
                self.ends = (row["turn"] if self.ends is None else self.ends[0], row["turn"])
            self.counts[4] += {"K": KEEP, "R": REROLE, "D": DELETE}[row["edit"]] + CUT_OFF * (cut and row["edit"] != "D") + DELETE * (copies - 1)
        self.counts[4] += INSERT * (len(row["before"]) + len(row["after"]))
        self.audit.append("I" * len(row["before"]) + row["edit"] + "D" * max(0, copies - 1) + "I" * len(row["after"]))
        for _, role, text in made:
            self.hash.update(f"{chr(10) * (self.turns > 0)}{role}:{text}".encode())
            self.turns += 1

    def row(self) -> tuple:
        gaps = self.ends[1] - self.ends[0] + 1 - self.distinct if self.ends else 0
        return (self.conv_id, gaps, *self.counts, "".join(self.audit), self.hash.hexdigest())


def _reports(it):
    def batch(rows):
        kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in REPORT.split(", ")])

    now, out = None, []
    for row, made in _script(it):
        if now is None or now.conv_id != row["conv_id"]:
            if now:
                out.append(now.row())
            now = _Report(row["conv_id"])
            if len(out) > 1000:
                yield batch(out)
                out = []
        now.add(row, made)
    if now:
        out.append(now.row())
    yield batch(out)


def repair_report(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of turns (conv_id, turn, role, text, copies)."""
    return _met(turns, edits(turns)).repartition("conv_id").sortWithinPartitions(*_ORDER).mapInArrow(_reports, REPORT)
