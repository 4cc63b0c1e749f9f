"""Links between nodes that share a bucket, confirmed pair by pair, and their connected components.

No bucket is capped and no bucket emits all its pairs: every member is first compared with
the bucket's most central node; after the components of the confirmed links are known, only members of
*different* components are still compared, small buckets at once and large ones pivot by pivot until
no untested pair of components is left. Pivots are the most central nodes, those whose buckets hold the most members. What is skipped could not change a component.

Candidate pairs are confirmed cell by cell: a node's largest bucket, cut into blocks of about BLOCK nodes, is its home; the pairs between two blocks
make a cell, into which each of its nodes brings its set once, however many pairs it has there. A dense cell counts all
intersections by matrix products, a sparse one by merging sorted sets; both are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_of, durable, gathered, mix, parts_for

#: Buckets up to this many members compare all pairs of different components in one round.
SMALL_BUCKET = 48
#: Pivots that a larger bucket compares in one round.
PIVOTS = 512
#: Nodes of a block, by expectation; a cell holds the pairs of two blocks.
BLOCK = 256
#: Rows of a few numbers up to which a table is broadcast (about 100 bytes each once hashed).
FEW = 300_000
#: From this many pairs on, a cell counts by matrix products over so many set members at a time.
DENSE_PAIRS, STRIP = 24, 4096


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected edges (a, b) by alternating large-star and small-star.

    component is the smallest node reachable. Nodes without an edge to another node do not appear; null ends are dropped. Hubs only ever go
    through a minimum with map-side combining and a join whose large side adaptive execution may split.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = durable(e, "edges"), None
    parts = parts_for(e.sparkSession, 2 * e.count())
    while True:
        both = gathered(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), parts, "u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = gathered(large.where("u <> v"), parts, "u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(gathered(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v"), parts, "u").distinct(), "stars")
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(20,0)))")).first()
        if now == before:
            return gathered(e.union(e.select("v", "v")).toDF("node", "component"), parts, "node").distinct()
        before = now


#: Entries (key, node) that a map task holds before it deals them out.
FLUSH = 1 << 21
#: A key with more nodes than this in one flush sends only two of them to meet the others: it is known to be shared.
KNOWN = 8
#: Fine parts of a shuffle partition; a task works on one at a time.
FINE = 4
_DEALT = "part int, kind int, blob binary"
_MET = "kind int, a long, b long, c long, d int"


def fine_parts(spark) -> int:
    return FINE * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Keys of 64 mixed bits to 0 .. parts - 1, in the order of the keys."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def dealt(keys: np.ndarray, nodes: np.ndarray, parts: int) -> pa.RecordBatch:
    """Entries (key, node) packed by parts of the key space, as rows (part, kind, blob).

    Kind 0 are keys and nodes that have to meet those of other tasks. Kind 1 are entries of keys that many nodes here share: all but two of
    these nodes are members whatever the other tasks hold, so they are dealt evenly, and a key that a third of all rows have never fills one part.
    """
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))[: len(keys)]
    keys, nodes = keys[fresh], nodes[fresh]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    sizes = np.diff(np.append(begins, len(keys)))
    place = np.arange(len(keys)) - np.repeat(begins, sizes)
    known = (np.repeat(sizes, sizes) > KNOWN) & (place > 1)
    rows = []
    for kind, (k, n) in enumerate(((keys[~known], nodes[~known]), (keys[known], nodes[known]))):
        if kind:
            where = _part_of(mix(n.view(np.uint64)), parts)
            order = np.argsort(where, kind="stable")
            k, n, where = k[order], n[order], where[order]
        else:
            where = _part_of(k, parts)
        cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1])[: len(where)])
        for x, y in zip(cuts, np.append(cuts[1:], len(where))):
            rows.append((int(where[x]), kind, k[x:y].tobytes() + n[x:y].tobytes()))
    return rows_of(rows)


def rows_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "blob"])


def _deal_bands(parts: int):
    def run(it):
        keys, nodes, held = [], [], 0
        for batch in it:
            bands = column_of(batch, "bands")
            sizes = np.diff(bands.offsets.to_numpy())
            keys.append(bands.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            nodes.append(np.repeat(column_of(batch, "node").to_numpy(zero_copy_only=False).astype(np.int64), sizes))
            held += len(keys[-1])
            if held > FLUSH:
                yield dealt(np.concatenate(keys), np.concatenate(nodes), parts)
                keys, nodes, held = [], [], 0
        if held:
            yield dealt(np.concatenate(keys), np.concatenate(nodes), parts)

    return run


def _meet(it):
    """Rows sorted by part to (kind 0: key a, node b) for the members of buckets that two nodes or more share, and to whatever else was sent along unaltered (kind 2: a, b, c, d)."""

    def out(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns[0])
        full = [*columns, *[np.zeros(n, np.int64)] * (3 - len(columns)), np.zeros(n, np.int32)][:4] if len(columns) < 4 else list(columns)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(pa.array, full)], names=["kind", "a", "b", "c", "d"])

    def shared(blobs: list[bytes]) -> pa.RecordBatch:
        halves = [np.frombuffer(x, np.int64).reshape(2, -1) for x in blobs]
        keys, nodes = (np.concatenate([h[i] for h in halves]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, nodes = keys[order], nodes[order]
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        sizes = np.diff(np.append(begins, len(keys)))
        multi = np.minimum.reduceat(nodes, begins) != np.maximum.reduceat(nodes, begins)
        kept = np.repeat(multi, sizes)
        return out(0, keys[kept], nodes[kept])

    now, blobs = None, []
    for batch in it:
        for part, kind, blob in zip(*(column_of(batch, c).to_pylist() for c in ("part", "kind", "blob"))):
            if part != now:
                if blobs:
                    yield shared(blobs)
                now, blobs = part, []
            if kind == 0:
                blobs.append(blob)
            elif kind == 1:
                yield out(0, *np.frombuffer(blob, np.int64).reshape(2, -1))
            else:
                n = len(blob) // 28
                wide = np.frombuffer(blob, np.int64, 3 * n).reshape(3, -1)
                yield out(2, *wide, np.frombuffer(blob, np.int32, n, 24 * n))
    if blobs:
        yield shared(blobs)


def met(sent: DataFrame) -> DataFrame:
    """The rows (part, kind, blob) of all tasks brought together, part by part; to be made durable by the caller."""
    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_meet, _MET)


def counted(entries: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Entries (key, node) of shared buckets to the pairs of two-member buckets (a, b), and the members (key, node, w, n) of larger ones; w is how many members a node's buckets hold, n how many the bucket holds."""
    rows = durable(entries.distinct(), f"{label}-entries")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1")
    sizes = durable(sizes, f"{label}-buckets")
    keys = sizes.where("n > 2").select("key", "n")
    members = durable(rows.join(broadcast_if_few(keys), "key"), f"{label}-members")
    weights = members.groupBy("node").agg(F.sum("n").alias("w"))
    members = durable(members.join(weights, "node").select("key", "node", "w", "n"), f"{label}-members")
    return sizes.where("n = 2").select("a", "b").distinct(), members


def shared_buckets(signatures: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """signatures (node, bands array<bigint>) to the pairs and members of counted()."""
    sent = signatures.select("node", "bands").mapInArrow(_deal_bands(fine_parts(signatures.sparkSession)), _DEALT)
    return counted(met(sent).select(F.col("a").alias("key"), F.col("b").alias("node")), label)


def broadcast_if_few(table: DataFrame) -> DataFrame:
    """A written table, broadcast when it has at most FEW rows: joins with it then deal nothing by a key, hot or not. Larger ones are shuffled, and adaptive execution splits hot keys."""
    return F.broadcast(table) if table.count() <= FEW else table


def overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many members sets[rows[i]] and sets[columns[j]] share, for all rows[i] other than columns[j]; sets are sorted and distinct."""
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # A member of one set only is in no intersection.
    common = times > 1
    kept = common[member]
    own, member = own[kept], (np.cumsum(common) - 1)[member[kept]]
    order = np.argsort(member, kind="stable")
    own, member = own[order], member[order]
    both = np.zeros((len(rows), len(columns)), np.float32)
    for low in range(0, int(common.sum()), STRIP):
        x, y = np.searchsorted(member, [low, low + STRIP])
        strip = np.zeros((len(sets), STRIP), np.float32)
        strip[own[x:y], member[x:y] - low] = 1
        both += strip[rows] @ strip[columns].T
    return both


def shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members sets[a[i]] and sets[b[i]] share, for each i; a[i] is never b[i]."""
    if len(a) < DENSE_PAIRS:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    rows, row = np.unique(a, return_inverse=True)
    columns, column = np.unique(b, return_inverse=True)
    return overlaps(sets, rows, columns)[row, column].astype(np.int64)


def _block_links(decode: Callable[[bytes], np.ndarray], percent: int):
    """Rows (cell, node, comp, pivot, payload) sorted by cell to links between a block and its bucket's pivots: enough of them to join all components that are linked in the cell."""

    def judged(rows: list) -> pa.RecordBatch:
        nodes, comps, pivot, payloads = zip(*rows)
        sets, comps, pivot = [decode(x) for x in payloads], np.array(comps, np.int64), np.array(pivot, bool)
        sizes, ps, ms = np.array([len(x) for x in sets], np.float64), np.flatnonzero(pivot), np.flatnonzero(~pivot)
        a, b, root = [], [], {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        if len(ps) and len(ms):
            both = overlaps(sets, ps, ms).astype(np.float64)
            good = (both > 0) & (100 * both >= percent * (sizes[ps][:, None] + sizes[ms][None, :] - both)) & (comps[ps][:, None] != comps[ms][None, :])
            for i, j in zip(*np.nonzero(good)):
                x, y = int(ps[i]), int(ms[j])
                cx, cy = find(int(comps[x])), find(int(comps[y]))
                if cx != cy:
                    root[cx] = cy
                    a.append(min(nodes[x], nodes[y]))
                    b.append(max(nodes[x], nodes[y]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(it):
        now, rows = None, []
        for batch in it:
            for cell, *row in zip(*(column_of(batch, c).to_pylist() for c in ("cell", "node", "comp", "pivot", "payload"))):
                if cell != now:
                    if rows:
                        yield judged(rows)
                    now, rows = cell, []
                rows.append(row)
        if rows:
            yield judged(rows)

    return run


def _against_pivots(big: DataFrame, pivots: DataFrame, sets: DataFrame, decode: Callable[[bytes], np.ndarray], percent: int, parts: int) -> DataFrame:
    """Links (a, b) between the open nodes of large buckets (key, node, n, comp) and the buckets' pivots, block by block: every pivot is sent to every block of its bucket once, and no pair becomes a row."""
    blocks = F.ceil(F.col("n") / (2 * BLOCK)).cast("int")
    members = big.select(F.xxhash64("key", F.pmod(F.xxhash64("node"), blocks)).alias("cell"), "node", "comp", F.lit(False).alias("pivot"))
    spread = big.select("key", "n").distinct().join(pivots, "key").select("key", "p", "pc", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    sent = spread.select(F.xxhash64("key", F.col("block").cast("long")).alias("cell"), F.col("p").alias("node"), F.col("pc").alias("comp"), F.lit(True).alias("pivot"))
    rows = gathered(members.union(sent), parts, "node").join(gathered(sets, parts, "node"), "node").select("cell", "node", "comp", "pivot", "payload")
    rows = rows.repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(_block_links(decode, percent), "a long, b long").distinct()


def _cell_links(decode: Callable[[bytes], np.ndarray], percent: int):
    """Rows sorted by cell, in a cell first the sets (a, payload) and then the pairs (a, b), to the pairs that are links."""

    def judged(nodes: list, payloads: list, a: list, b: list) -> pa.RecordBatch:
        sets, places = [decode(x) for x in payloads], {}
        for i, node in enumerate(nodes):
            places.setdefault(node, []).append(i)
        # A node has several sets only if rows repeat its id with other texts: any of them may link.
        tried = [(x, y, i, j) for x, y in zip(a, b) for i in places.get(x, ()) for j in places.get(y, ())]
        x, y, i, j = (np.array(c, np.int64) for c in zip(*tried)) if tried else (np.zeros(0, np.int64),) * 4
        both = shared(sets, i, j) if len(i) else i
        sizes = np.array([len(s) for s in sets], np.int64)
        good = (both > 0) & (100 * both >= percent * (sizes[i] + sizes[j] - both)) if len(i) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(x[good]), pa.array(y[good])], names=["a", "b"])

    def run(it):
        now, nodes, payloads, left, right = None, [], [], [], []
        for batch in it:
            rows = zip(*(column_of(batch, c).to_pylist() for c in ("cell", "a", "b", "payload")))
            for cell, a, b, payload in rows:
                if cell != now:
                    if left:
                        yield judged(nodes, payloads, left, right)
                    now, nodes, payloads, left, right = cell, [], [], [], []
                if b is None:
                    nodes.append(a)
                    payloads.append(payload)
                else:
                    left.append(a)
                    right.append(b)
        if left:
            yield judged(nodes, payloads, left, right)

    return run


def set_confirmer(members: DataFrame, sets: DataFrame, percent: int, decode: Callable[[bytes], np.ndarray], label: str) -> Callable[[DataFrame], DataFrame]:
    """A confirm() for link(): pairs whose sets share at least percent of their union. sets is (node, n, payload), n the set's size and decode(payload) the sorted set."""
    home = members.groupBy("node").agg(F.max(F.struct("n", "key")).alias("top"))
    block = F.xxhash64("top.key", F.pmod(F.xxhash64("node"), F.ceil(F.col("top.n") / BLOCK)))
    homes = sets.groupBy("node").agg(F.min("n").alias("least"), F.max("n").alias("most")).join(home, "node", "left")
    homes = durable(homes.select("node", "least", "most", F.when(F.col("top").isNull(), F.col("node")).otherwise(block).alias("block")), f"{label}-homes")
    spark, n_homes = sets.sparkSession, homes.count()

    def confirm(candidates: DataFrame) -> DataFrame:
        # A bucket's leader stands in a pair with every member, so pairs are not dealt by one of their ends where that can be helped.
        left, right = (homes.toDF(*(x + c for c in ("", "least", "most", "block"))) for x in "ab")
        if n_homes <= FEW:
            left, right = F.broadcast(left), F.broadcast(right)
        sized = candidates.join(left, "a").join(right, "b")
        # Sets whose sizes alone rule a link out.
        sized = sized.where(F.col("amost") * 100 >= F.col("bleast") * percent).where(F.col("bmost") * 100 >= F.col("aleast") * percent)
        cells = durable(sized.select(F.xxhash64(F.least("ablock", "bblock"), F.greatest("ablock", "bblock")).alias("cell"), "a", "b"), f"{label}-cells")
        # Sets are wider than pairs, and comparing them is the work: more and smaller parts.
        parts = parts_for(spark, cells.count(), 5_000)
        ends = gathered(cells.select("cell", F.col("a").alias("node")).union(cells.select("cell", "b")), parts, "node").distinct()
        brought = ends.join(gathered(sets, parts, "node"), "node").select("cell", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "payload")
        rows = brought.union(cells.select("cell", "a", "b", F.lit(None).cast("binary")))
        rows = (rows.repartition(parts, "cell") if parts < int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition("cell")).sortWithinPartitions("cell", F.col("b").isNotNull())
        return gathered(rows.mapInArrow(_cell_links(decode, percent), "a long, b long"), parts, "a").distinct()

    return confirm


def link(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int, decode: Callable[[bytes], np.ndarray], label: str) -> DataFrame:
    """(node, component) over all links among nodes that share a bucket: sets that share at least percent of their union.

    sets is (node, n, payload) of all these nodes, n the set's size and decode(payload) the sorted set.
    """
    confirm = set_confirmer(members, sets, percent, decode, label)
    spark, n_members = members.sparkSession, members.count()
    parts = parts_for(spark, n_members)
    leader = durable(members.groupBy("key").agg(F.max(F.struct("w", "node")).alias("top")).select("key", F.col("top.node").alias("a")), f"{label}-leaders")
    leader = broadcast_if_few(leader)
    first = members.join(leader, "key").where("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    tested = durable(gathered(pairs.union(first), parts, "a", "b").distinct(), f"{label}-pairs")
    links = durable(confirm(tested), f"{label}-links")
    state = durable(members.join(leader, "key").select("key", "node", "w", (F.col("node") == F.col("a")).alias("done")), f"{label}-state")
    comps = None
    while True:
        if comps is None:
            comps = durable(connected_components(links), f"{label}-comps")
        now = gathered(state, parts, "node").join(gathered(comps, parts, "node"), "node", "left").select("key", "node", "w", "done", F.coalesce("component", "node").alias("comp"))
        now = durable(now, f"{label}-state")
        left = now.where("not done").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
        left = durable(left, f"{label}-open-keys")
        if left.isEmpty():
            return comps
        now = durable(now.join(broadcast_if_few(left), "key"), f"{label}-open")
        n_open = now.count()
        parts = parts_for(spark, n_open)
        x, y = now.where("not done").alias("x"), now.where("not done").alias("y")
        near = x.where(F.col("n") <= SMALL_BUCKET).join(y, F.expr("x.key = y.key and x.node < y.node and x.comp <> y.comp")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        big = now.where("not done").where(F.col("n") > SMALL_BUCKET)
        pivots = durable(_pivots(big), f"{label}-pivots")
        wide = parts_for(spark, n_open * SMALL_BUCKET)
        fresh = gathered(near, wide, "a", "b").distinct().join(gathered(tested, wide, "a", "b"), ["a", "b"], "left_anti")
        fresh = durable(fresh, f"{label}-pairs")
        tested = tested.union(fresh)
        found = durable(confirm(fresh).union(_against_pivots(big, pivots, sets, decode, percent, parts)), f"{label}-links")
        if not found.isEmpty():
            links, comps = links.union(found), None
        was = gathered(pivots.select("key", F.col("p").alias("node"), F.lit(True).alias("was")), parts, "key")
        state = now.where(F.col("n") > SMALL_BUCKET).join(was, ["key", "node"], "left").select("key", "node", "w", (F.col("done") | F.coalesce("was", F.lit(False))).alias("done"))
        state = durable(state, f"{label}-state")


def _pivots(big: DataFrame) -> DataFrame:
    """(key, p, pc): up to PIVOTS nodes of each bucket and their components, the most central of every component first.

    A bucket's largest component offers one only: once all nodes outside it have been compared, the bucket is closed.
    """
    sizes = big.groupBy("key", "comp").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top")).select("key", F.col("top.comp").alias("largest"))
    inside = big.withColumn("rank", F.row_number().over(Window.partitionBy("key", "comp").orderBy(F.desc("w"), "node"))).where(F.col("rank") <= PIVOTS)
    inside = inside.join(largest, "key").where("comp <> largest or rank = 1")
    order = Window.partitionBy("key").orderBy("rank", F.desc("w"), "node")
    return inside.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS).select("key", F.col("node").alias("p"), F.col("comp").alias("pc"))
