"""Merkle manifest of a table: one tree for each source, a tree over their roots, and a proof for every row.

1. *Leaves.* Every row becomes the digest of its fields, inside the scan. Leaves get their places by a range sort (source, doc_id, digest, row), so that a source of
   any size is dealt over many tasks; counts by task and source tell where each task's run of a source starts, and how large the source is.
2. *Events.* A parent is known by (source, level, index); the size of the source says how many children it has. A task feeds its leaves in and keeps partial
   parents: a digest that arrives takes its slot, and a parent that has all its children is hashed and becomes an event for its own parent.
3. *Frontiers.* What is left incomplete at a task's ends is combined with combineByKey, by the ancestor REACH levels up, and the same events run on; a few
   rounds resolve all. Roots of sources are leaves of the upper tree, which is built by the same steps.
4. *Proofs.* Each completed parent keeps its children, so a child's reverse link (level + 1, index / ARITY) leads to its siblings. From the root down, REACH levels at a
   time, paths and parents meet the nodes (at last the rows) below them by a shuffle on that ancestor, and a task streams them in order: path, parents, rows.

No group is larger than a subtree of ARITY ** REACH leaves. With one source for each row, the paths of the upper tree are as large as ARITY digests a level and row.

Edge cases. A null field is told apart from an empty one. Rows of one source and doc_id are ordered by their digests, null doc_ids first; equal rows are
leaves of their own, each with its own proof. A null source is a source of its own, before all others; a null doc_id is never tampered with. An empty table gives an empty result; other columns
are ignored, whatever their names. Texts of any length are hashed whole, by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column_of, durable, parts_for

ARITY, REACH = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A parent: its children by slot, and once it has all of them their digest; top marks the root of its tree.
NODES = "tree string, size long, level int, idx long, children array<string>, digest string, top boolean"
PATH = "array<struct<at:int,others:array<string>>>"
#: What meets below one ancestor: kind 0 its path to the root, 1 parents below it, 2 the nodes or rows whose paths are asked for.
MEETING = f"tree string, block long, kind int, level int, idx long, size long, children array<string>, path {PATH}, subroot string, key string, doc_id long, leaf string, altered string"
NAMES = [x.split()[0] for x in MEETING.replace(PATH, "x").split(", ")]


def field(c: Column) -> Column:
    """`-`, or byte count, colon and value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def row_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def joined_digest(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def level_sizes(n: int) -> list[int]:
    """Nodes of each level, from the leaves to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def depth_of(n: int) -> int:
    return len(level_sizes(n)) - 1


class Parents:
    """Partial parents, and the events that complete them."""

    def __init__(self):
        self.partial: dict[tuple, list] = {}
        self.complete: list[tuple] = []
        self.sizes: dict[int, list[int]] = {}

    def levels(self, size: int) -> list[int]:
        if size not in self.sizes:
            if len(self.sizes) > 1000:
                self.sizes.clear()
            self.sizes[size] = level_sizes(size)
        return self.sizes[size]

    def arrives(self, tree: str | None, size: int, level: int, idx: int, digest: str) -> None:
        """A node of this level is known: it takes its slot, and so do the ancestors that it completes."""
        levels = self.levels(size)
        while level < len(levels) - 1:
            above, slot = divmod(idx, ARITY)
            slots = self.partial.setdefault((tree, size, level + 1, above), {})
            slots[slot] = digest
            if len(slots) < min(ARITY, levels[level] - above * ARITY):
                return
            del self.partial[tree, size, level + 1, above]
            children = [slots[k] for k in range(len(slots))]
            level, idx, digest = level + 1, above, joined_digest(children)
            self.complete.append((tree, size, level, idx, children, digest, level == len(levels) - 1))

    def take(self) -> list[tuple]:
        out, self.complete = self.complete, []
        return out

    def left(self) -> list[tuple]:
        """Partial parents as rows, missing children as nulls."""
        out = [(*key, [slots.get(k) for k in range(ARITY)], None, False) for key, slots in self.partial.items()]
        self.partial = {}
        return out


# -- places -------------------------------------------------------------------
def placed(items: DataFrame, order: list[str], label: str) -> DataFrame:
    """items (tree, ...) with idx, the place in its tree by `order` (nulls first), and size of that tree; sorted by both inside each task."""
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = items.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    rows = durable(ordered.withColumn("seq", F.monotonically_increasing_id()), label).withColumn("part", F.shiftright("seq", 33))
    runs = durable(rows.groupBy("part", "tree").agg(F.count("*").alias("n"), F.min("seq").alias("first")), label + "-runs")
    # A tree has at most one run in each task, so these windows hold a row for each task at most.
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("part").alias("in_part"), F.col("tree").alias("of"), (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_ROWS // 8 else runs
    joined = rows.join(runs, (F.col("part") == F.col("in_part")) & F.col("tree").eqNullSafe(F.col("of")))
    return joined.select(*items.columns, (F.col("seq") + F.col("shift")).alias("idx"), "size").sortWithinPartitions("tree", "idx")


# -- parents ------------------------------------------------------------------
def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()]
    names = ["tree", "size", "level", "idx", "children", "digest", "top"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)


def _local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All parents that a task's own leaves complete, then its frontier."""
    parents, now = Parents(), None
    for batch in it:
        for tree, size, idx, digest in zip(*(column_of(batch, n).to_pylist() for n in ("tree", "size", "idx", "digest"))):
            if now != (tree, size):
                now = tree, size
                parents.complete += parents.left()
            parents.arrives(tree, size, 0, idx, digest)
        yield _batch(parents.take())
    yield _batch(parents.left())


def _add(parents: Parents, row) -> Parents:
    """A partial parent's children arrive one by one."""
    for slot, digest in enumerate(row["children"]):
        if digest is not None:
            parents.arrives(row["tree"], row["size"], row["level"] - 1, row["idx"] * ARITY + slot, digest)
    return parents


def _merge(parents: Parents, other: Parents) -> Parents:
    parents.complete += other.take()
    for (tree, size, level, idx), slots in other.partial.items():
        for slot, digest in slots.items():
            parents.arrives(tree, size, level - 1, idx * ARITY + slot, digest)
    return parents


def parents_of(leaves: DataFrame, label: str) -> DataFrame:
    """All parents (NODES) of the trees whose leaves (tree, size, idx, digest) these are."""
    spark = leaves.sparkSession
    nodes = durable(leaves.select("tree", "size", "idx", "digest").mapInArrow(_local, NODES), label)
    done = nodes.where("digest is not null")
    open_ = nodes.where("digest is null")
    while True:
        rows, lowest = open_.agg(F.count("*"), F.min("level")).first()
        if not rows:
            return done
        level = lowest + REACH - 1
        parts = parts_for(spark, rows, 10_000)
        key = lambda r, level=level: (r["tree"], max(r["level"], level), r["idx"] // ARITY ** max(0, level - r["level"]))
        combined = open_.rdd.keyBy(key).combineByKey(lambda r: _add(Parents(), r), _add, _merge, parts)
        nodes = durable(spark.createDataFrame(combined.values().flatMap(lambda p: [*p.take(), *p.left()]), NODES), label)
        done, open_ = done.unionByName(nodes.where("digest is not null")), nodes.where("digest is null")


# -- proofs -------------------------------------------------------------------
def _steps(nodes: dict, level: int, idx: int, top: int) -> list[tuple[int, list[str]]]:
    """Along the reverse links up to level top: slot and siblings at each level."""
    out = []
    while level < top:
        above, at = divmod(idx, ARITY)
        out.append((at, nodes[level + 1, above][:at] + nodes[level + 1, above][at + 1 :]))
        level, idx = level + 1, above
    return out


def folded(digest: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root that a digest and its siblings make."""
    for at, others in steps:
        digest = joined_digest([*others[:at], digest, *others[at:]])
    return digest


def _meet(base: int):
    """Streams meetings; yields (row, steps, subroot) for each row of kind 2."""

    def run(it):
        block, nodes, above, subroot, top, known = None, {}, [], None, 0, (None, [])
        for batch in it:
            for row in zip(*(column_of(batch, n).to_pylist() for n in NAMES)):
                tree, at, kind, level, idx, size, children, path, root = row[:9]
                if (tree, at) != block:
                    block, nodes, above, known = (tree, at), {}, None, (None, [])
                if kind == 0:
                    above, subroot, top = [(p["at"], p["others"]) for p in path], root, level
                elif kind == 1:
                    nodes[level, idx] = children
                else:
                    if top > base and known[0] != idx // ARITY:
                        known = idx // ARITY, _steps(nodes, base + 1, idx // ARITY, top) + above
                    yield row, (_steps(nodes, base, idx, base + 1) + known[1] if top > base else above), subroot

    return run


def _paths(base: int):
    def run(it):
        out = []
        for row, steps, subroot in _meet(base)(it):
            out.append((row[0], row[5], base, row[4], [{"at": a, "others": o} for a, o in steps], subroot, row[9], row[11]))
            if len(out) == 500:
                yield _path_batch(out)
                out = []
        yield _path_batch(out)

    return run


PATHS = f"tree string, size long, level int, idx long, path {PATH}, subroot string, key string, leaf string"


def _path_batch(rows: list[tuple]) -> pa.RecordBatch:
    step = pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))])
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(step), pa.string(), pa.string(), pa.string()]
    names = ["tree", "size", "level", "idx", "path", "subroot", "key", "leaf"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(root: str):
    def run(it):
        out = []
        for row, steps, subroot in _meet(0)(it):
            got = folded(row[12] or row[11], steps)
            out.append((row[10], row[11], subroot, root, joined_digest([x for _, others in steps for x in others]), got, got == root))
            if len(out) == 5000:
                yield _proof_batch(out)
                out = []
        yield _proof_batch(out)

    return run


def _proof_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in PROOFS.split(", ")])


def _meeting(df: DataFrame, kind: int, block: Column) -> DataFrame:
    """df in the columns of MEETING."""
    have = set(df.columns)
    types = dict(zip(NAMES, [x.split(" ", 1)[1] for x in MEETING.replace(PATH, "x").split(", ")])) | {"path": PATH}
    given = {"block": block.cast("long"), "kind": F.lit(kind)}
    return df.select(*(given[n].alias(n) if n in given else (F.col(n) if n in have else F.lit(None)).cast(types[n]).alias(n) for n in NAMES))


def descend(tops: DataFrame, nodes: DataFrame, items: DataFrame, deepest: int, last) -> DataFrame:
    """Paths from the trees' roots (tops, in the columns of PATHS) down to items at level 0; `last` gives the mapper of that step and its schema."""
    nodes = nodes.withColumn("subroot", F.lit(None).cast("string"))
    above = None
    for base in reversed(range(0, max(deepest, 1), REACH)):
        up = ARITY**REACH
        starts = tops.where((F.col("level") > base) & (F.col("level") <= base + REACH) if base else F.col("level") <= REACH)
        starts = starts if above is None else starts.unionByName(above)
        span = (F.col("level") > base) & (F.col("level") <= base + REACH)
        block = F.expr(f"idx div cast(pow({ARITY}, {base + REACH} - level) as long)")
        below = items if base == 0 else nodes.where((F.col("level") == base) & ~F.col("top"))
        met = _meeting(starts, 0, F.when(F.col("level") < base + REACH, F.lit(0)).otherwise(F.col("idx")))
        met = met.unionByName(_meeting(nodes.where(span), 1, block)).unionByName(_meeting(below, 2, F.expr(f"idx div {up}")))
        met = met.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", F.desc("level"), "idx")
        if base == 0:
            run, schema = last
            return met.mapInArrow(run, schema)
        above = durable(met.mapInArrow(_paths(base), PATHS), "paths")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, altered: Column | None = None, label: str = "merkle") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs (doc_id, source and the other fields).

    `altered` is the digest of a row as it is shown to the check, where it is not the original one; null elsewhere."""
    leaf = row_digest([F.col(f) for f in fields])
    altered = F.lit(None).cast("string") if altered is None else altered
    leaves = docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), altered.alias("altered"))
    leaves = durable(leaves.withColumn("row", F.monotonically_increasing_id()), f"{label}-leaves")
    leaves = placed(leaves, ["doc_id", "digest", "row"], f"{label}-places")
    nodes = parents_of(leaves, f"{label}-nodes")
    roots = nodes.where("top").select("tree", "size", "level", "digest").unionByName(leaves.where("size = 1").select("tree", "size", F.lit(0).alias("level"), "digest"))
    roots = durable(roots.select(F.lit("sources").alias("tree"), F.col("tree").alias("key"), F.col("size").alias("rows"), F.col("level").alias("depth"), "digest"), f"{label}-roots")
    upper = placed(roots, ["key"], f"{label}-sources")
    upper_nodes = parents_of(upper, f"{label}-upper")
    found = upper_nodes.where("top").select("size", "level", "digest").unionByName(upper.where("size = 1").select("size", F.lit(0).alias("level"), "digest")).take(1)
    if not found:
        return docs.sparkSession.createDataFrame([], PROOFS)
    n, height, root = found[0]
    path = F.array().cast(PATH)
    tops = docs.sparkSession.range(1).select(F.lit("sources").alias("tree"), F.lit(n).alias("size"), F.lit(height).cast("int").alias("level"), F.lit(0).cast("long").alias("idx"), path.alias("path"))
    tops = tops.select("*", *(F.lit(None).cast("string").alias(c) for c in ("subroot", "key", "leaf")))
    items = upper.withColumn("leaf", F.col("digest")).withColumn("altered", F.col("rows").cast("string"))
    paths = durable(descend(tops, upper_nodes, items, height, (_paths(0), PATHS)), f"{label}-tops")
    # A path of the upper tree becomes the path of that source's root; size and depth of a source come back with its name.
    depths = roots.select(F.col("key").alias("of"), F.col("rows").alias("n"), F.col("depth"))
    tops = paths.join(depths, F.col("key").eqNullSafe(F.col("of"))).select(F.col("key").alias("tree"), F.col("n").alias("size"), F.col("depth").cast("int").alias("level"), F.lit(0).cast("long").alias("idx"), "path", F.col("leaf").alias("subroot"), "key", "leaf")
    deepest = roots.agg(F.max("depth")).first()[0]
    items = leaves.withColumnRenamed("digest", "leaf")
    return descend(tops, nodes, items, deepest, (_proofs(root), PROOFS))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest, where the rows with crc32(doc_id as text) divisible by 5 are shown with A-Z of their texts in lower case."""
    fields = [F.translate(f, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if f == "text" else F.col(f) for f in FIELDS]
    return manifest(docs, altered=F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, row_digest(fields)))
