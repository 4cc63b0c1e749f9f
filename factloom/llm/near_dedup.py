"""MinHash near-duplicate documents: many universal hash minima, banding, exact confirmation, star components.

A class is all rows with one shingle set (128 bits); classes have numbers of their own, so that a doc_id is never mistaken for a text.

Edge cases. Null, empty and blank texts have an empty set, link with nothing and are their own component; a text of one word has that word
as its only shingle. Rows that repeat a doc_id are each judged by their own text: a row's component_id is the smallest doc_id among the rows whose texts are
linked with its text, and rows of one doc_id with different texts may have different ones. Rows without doc_id take no part in any group: component_id is
null and they are kept. Long texts are used whole. An empty table gives an empty result. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WordHashes, column_of, durable, hashed_words, keep_ids, mix, release, rolling, texts_of
from .linking import link, shared_buckets

BANDS, ROWS = 56, 8
_rng = np.random.default_rng(20_408)
#: x -> a x + b mod 2**32 with odd a: universal, and a bijection, so that minima never tie between different shingles' hashes.
_A = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_BASE = 0x9E3779B97F4A7C15


def shingle_sets(texts: list[bytes], words: int, memo: WordHashes) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `words` words, A-Z lower-cased."""
    h, starts = hashed_words([t.lower().split() for t in texts], memo)
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        k = min(words, b - a)
        out.append(np.unique(mix(rolling(h[a:b], k, _BASE) + np.uint64(k))) if k else np.zeros(0, np.uint64))
    return out


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS 64-bit band keys for each set; sets must not be empty."""
    starts = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    v = np.empty_like(x)
    for i in range(BANDS * ROWS):
        np.multiply(x, _A[i], out=v)
        v += _B[i]
        band = i // ROWS
        keys[:, band] = keys[:, band] * np.uint64(_BASE) + np.minimum.reduceat(v, starts)
    return mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_BASE))


def _sums(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart: two sums of their hashes."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s + np.uint64(_BASE)).sum(dtype=np.uint64).view(np.int64))


_SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"


def _signatures(words: int):
    def run(it):
        release("near dedup")
        memo = WordHashes()
        for big in it:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                sets = shingle_sets(texts_of(batch), words, memo)
                full = [i for i, s in enumerate(sets) if len(s)]
                flat = bands_of([sets[i] for i in full]).view(np.int64) if full else np.zeros((0, BANDS), np.int64)
                sizes = np.zeros(len(sets) + 1, np.int32)
                sizes[np.array(full, np.int64) + 1] = BANDS
                sums = np.array([_sums(s) for s in sets], np.int64).reshape(-1, 2)
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), bands], names=["doc_id", "n_shingles", "f1", "f2", "bands"])

    return run


def _sets(words: int):
    """A row of node, size, both sums and the set itself for each text."""

    def run(it):
        release("near dedup")
        memo = WordHashes()
        for big in it:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                sets = shingle_sets(texts_of(batch), words, memo)
                sums = np.array([_sums(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [column_of(batch, "doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "n", "f1", "f2", "payload"],
                )

    return run


def _members(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint64)


def near_duplicate_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; links need percent/100 similarity of full shingle sets.

    Copies of one set collapse before banding, so that a group of equal texts costs one signature. A pair at the threshold is
    missed by all 56 bands of 8 minima with probability 3e-5, while one at half of it shares a band with probability 0.2.
    """
    docs = docs.select("doc_id", "text")
    signed = durable(docs.mapInArrow(_signatures(words), _SIGNED), "signatures")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    pairs, members = shared_buckets(classes, "near")
    # The full sets of all candidates, made once from their texts.
    nodes = members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = durable(classes.select("node", "doc_id", "f1", "f2").join(nodes, "node", "left_semi"), "wanted-sets")
    sets = keep_ids(docs, wanted.select("doc_id").distinct(), "doc_id", wanted.count()).mapInArrow(_sets(words), "doc_id long, n long, f1 long, f2 long, payload binary")
    sets = durable(sets.join(wanted, ["doc_id", "f1", "f2"]).select("node", "n", "payload").dropDuplicates(["node"]), "sets")
    comps = link(pairs, members, sets, percent, _members, "near")
    named = classes.join(comps, "node", "left").select("f1", "f2", "doc_id", F.coalesce("component", "node").alias("component"))
    named = durable(named, "near-named")
    # A component is known by the smallest doc_id in it. Most classes are components of their own and need no grouping.
    least = named.join(comps.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "component", "left").select("f1", "f2", F.coalesce("least", "doc_id").alias("component_id"))
    out = signed.drop("bands").join(named, ["f1", "f2"], "left")
    # An empty set has no class: such a row is alone.
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without those rows whose document is not the smallest of its group. A row without doc_id stays, and so does a doc_id that any of its rows keeps."""
    groups = durable(near_duplicate_groups(docs, words, percent).where("doc_id is not null").select("doc_id", "kept"), "groups")
    gone = groups.where("not kept").select("doc_id").distinct().join(groups.where("kept"), "doc_id", "left_anti")
    gone = durable(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti")
