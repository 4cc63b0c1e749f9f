"""Quality classifier: random Fourier features of document statistics, ridge regression by summed normal equations, isotonic calibration.

Statistics are computed once per document and stored; fitting and scoring read the small table. FEATURES random cosines approximate a
Gaussian kernel of width WIDTH over standardised statistics. Each task adds its rows' share of the normal equations, shares are summed by a tree of
FAN_IN at a time, and the driver solves one FEATURES x FEATURES system. Scores are calibrated by pooling adjacent violators over at most BINS score bins.

Edge cases. Null and empty texts have all statistics 0 and get the score of such a document. Labels that are null count as missing. Without any label to
learn from every score is 0.5. Repeated rows are scored each; a repeated label counts each time, and of tied scores all get the same value. An empty table gives an
empty result. Very long texts are taken whole. Columns other than doc_id, text and quality are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, durable, release, split_column, texts_of

FEATURES, WIDTH, RIDGE, BINS, FAN_IN = 256, 4.0, 1e-3, 1024, 64
_UPPER, _DIGITS, _SYMBOLS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>"
_ENDS, _BREAKS = b".,;:", b"!?"


def _share(text: bytes, chars: bytes) -> float:
    return (len(text) - len(text.translate(None, chars))) / len(text)


def statistics(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * 16
    n, counts = len(words), Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = Counter(zip(words, words[1:]))
    most = counts.most_common(1)[0][1]
    return [
        np.log1p(n), np.log1p(len(text) / n), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        _share(text, _SYMBOLS), _share(text, _UPPER), _share(text, _DIGITS), _share(text, _ENDS), _share(text, _BREAKS), 1 - _share(text, bytes(range(128, 256))),
        len(counts) / n, most / n, np.log1p(len(counts)) / np.log1p(n), 1 - len(pairs) / max(1, n - 1),
        sum(a == b for a, b in zip(words, words[1:])) / n, len(min(words, key=len)) / 8,
    ]


def _statistics(it):
    release("quality classifier")
    for batch in it:
        values = np.array([statistics(t) for t in texts_of(batch)], np.float64).reshape(batch.num_rows, 16)
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * 16)
        yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id").cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=["doc_id", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return column_of(batch, "x").values.to_numpy()[: batch.num_rows * 16].reshape(-1, 16) if not column_of(batch, "x").offset else np.array(column_of(batch, "x").to_pylist())


def _cosines(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(4)
    w, b = rng.normal(0, 1 / WIDTH, (16, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.cos(np.clip((x - mean) / std, -6, 6) @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def _shares(mean, std):
    """A task's share of the normal equations, as bytes, under the number of the task."""

    def run(it):
        release("quality classifier")
        total, seen = np.zeros((FEATURES + 2, FEATURES + 2)), 0
        for batch in it:
            z = np.hstack([_cosines(_matrix(batch), mean, std), column_of(batch, "y").to_numpy(zero_copy_only=False).astype(float)[:, None]])
            total, seen = total + z.T @ z, seen + len(z)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["salt", "part"])

    return run


def _added(fan_in: int):
    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.column("part").to_pylist())
        return pa.table({"salt": pa.array([table.column("salt")[0].as_py() // fan_in], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    return run


def isotonic(score: np.ndarray, hits: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: scores (ascending) and the calibrated share at each."""
    blocks: list[list[float]] = []
    for s, h, c in zip(score, hits, count):
        blocks.append([s, s, h, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, h2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + h2, blocks[-1][3] + c2]
    xs = [e for lo, hi, _, _ in blocks for e in (lo, hi)]
    ys = [(h + 0.5) / (c + 1) for _, _, h, c in blocks for _ in (0, 1)]
    return np.array(xs), np.array(ys)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_mod: int = 3, held_out_rest: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; rows whose crc32(doc_id) mod held_out_mod is held_out_rest teach nothing."""
    x = durable(docs.select("doc_id", "text").mapInArrow(_statistics, "doc_id long, x array<double>"), "statistics")
    held = (split_column(x, held_out_mod) == held_out_rest).alias("held_out")
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("y is not null")
    train = durable(x.where(~held).join(known, "doc_id").select("doc_id", "x", "y"), "labelled")
    moments = train.select(*[F.avg(F.col("x")[i]) for i in range(16)], *[F.stddev_pop(F.col("x")[i]) for i in range(16)]).first()
    if moments[0] is None:
        return x.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    mean, std = np.array(moments[:16]), np.maximum(np.array(moments[16:]), 1e-6)
    parts = durable(train.select("x", "y").mapInArrow(_shares(mean, std), "salt int, part binary"), "shares")
    # A tree: sums of FAN_IN shares at a time, until few are left.
    while parts.count() > FAN_IN:
        parts = durable(parts.groupBy((F.col("salt") / FAN_IN).cast("int").alias("g")).applyInArrow(_added(FAN_IN), "salt int, part binary"), "shares")
    z = sum(np.frombuffer(r.part, np.float64) for r in parts.collect()).reshape(FEATURES + 2, FEATURES + 2)
    n = z[FEATURES, FEATURES]
    weights = np.linalg.solve(z[:-1, :-1] + RIDGE * n / FEATURES * np.eye(FEATURES + 1), z[:-1, -1])
    binned = train.select("y", "x", "doc_id").mapInArrow(_with_label(mean, std, weights), "y double, raw double")
    bins = binned.groupBy(F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "raw")) * (BINS / 2)).alias("bin")).agg(F.sum("y").alias("h"), F.count("*").alias("n"), F.avg("raw").alias("s")).orderBy("bin").collect()
    xs, ys = isotonic([b.s for b in bins], [b.h for b in bins], [b.n for b in bins])

    def calibrated(it):
        for batch in it:
            raw = _cosines(_matrix(batch), mean, std) @ weights
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), column_of(batch, "held_out"), pa.array(np.interp(raw, xs, ys))], names=["doc_id", "held_out", "score"])

    out = x.select("doc_id", held, "x").mapInArrow(calibrated, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _with_label(mean, std, weights):
    def run(it):
        release("quality classifier")
        for batch in it:
            yield pa.RecordBatch.from_arrays([column_of(batch, "y"), pa.array(_cosines(_matrix(batch), mean, std) @ weights)], names=["y", "raw"])

    return run
