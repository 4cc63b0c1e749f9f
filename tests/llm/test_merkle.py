"""The Merkle manifest against a plain version, over many sizes, and on odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from factloom.llm import merkle
from tests.llm.test_edges import odd  # noqa: F401

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, tree string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """Root, and for each leaf its steps (slot, siblings)."""
    steps, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(places):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            steps[k].append((p % 16, run[: p % 16] + run[p % 16 + 1 :]))
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        places = [p // 16 for p in places]
    return nodes[0], steps


def fold(digest, steps):
    for at, others in steps:
        digest = H(*others[:at], digest, *others[at:])
    return digest


def plain(rows):
    """rows (doc_id, source, lang, n_chars, text)."""
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for members in sources.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    built = {s: tree([leaf_of(r) for r in sources[s]]) for s in names}
    root, upper = tree([built[s][0] for s in names])
    out = []
    for s, up in zip(names, upper):
        for r, steps in zip(sources[s], built[s][1]):
            steps = steps + up
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                shown = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            got = fold(leaf_of(shown), steps)
            out.append((r[0], leaf_of(r), built[s][0], root, H(*(x for _, o in steps for x in o)), got, got == root))
    return out


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def given(sizes, seed=1):
    rng = random.Random(seed)
    ids = iter(rng.sample(range(10**6), sum(sizes.values())))
    return [(next(ids), s, rng.choice(["en", None, ""]), rng.choice([None, 3, 12]), rng.choice([None, "", "Über A", "plain", f"Text {rng.random()}"])) for s, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {"a": 16}, {"a": 17, None: 1}, {"b": 257, "": 16, None: 33, "é": 1, "z": 2}, {"hot": 4200, "x": 5}, {f"s{i}": 1 + i % 3 for i in range(300)}],
    ids=["one", "full", "two", "some", "hot", "many-sources"],
)
def test_equals_the_plain_version(spark, sizes):
    rows = given(sizes)
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, merkle.tampered_manifest(docs).collect()), key=key)
    assert got == sorted(plain(rows), key=key)


def test_one_level_at_a_time_gives_the_same(spark, monkeypatch):
    rows = given({"hot": 700, "x": 40, None: 3}, 2)
    docs = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    monkeypatch.setattr(merkle, "REACH", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "13")  # runs of a source over many tasks
    try:
        assert sorted(map(tuple, merkle.tampered_manifest(docs).collect()), key=key) == sorted(plain(rows), key=key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(spark, odd):  # noqa: F811
    docs = odd.unionByName(odd.where("doc_id in (1, 3)"))
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    got = sorted(map(tuple, merkle.tampered_manifest(docs).collect()), key=key)
    assert got == sorted(plain(rows), key=key)
    assert merkle.tampered_manifest(docs.limit(0)).count() == 0


def test_events_do_not_depend_on_their_order():
    leaves = [H(str(i)) for i in range(1000)]
    root, _ = tree(leaves)
    order = list(enumerate(leaves))
    random.Random(4).shuffle(order)
    parents = merkle.Parents()
    for i, d in order:
        parents.arrives("t", 1000, 0, i, d)
    assert not parents.left()
    assert [d for *_, d, top in parents.take() if top] == [root]


def test_a_partial_frontier_is_merged(spark):
    parents, other = merkle.Parents(), merkle.Parents()
    leaves = [H(str(i)) for i in range(40)]
    for i, d in enumerate(leaves):
        (parents if i % 2 else other).arrives(None, 40, 0, i, d)
    assert [d for *_, d, top in merkle._merge(parents, other).take() if top] == [tree(leaves)[0]]
