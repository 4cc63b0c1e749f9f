"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

The pre-tokens of a SentencePiece model are runs of word marks with what follows them, and line feeds (no piece spans their
borders, so counts add up). Frequent pre-tokens, taken from a sample of at most SAMPLE_ROWS rows and at most HOT_TOKENS of at most HOT_LENGTH
characters (so under 20 MB), travel as a broadcast and never enter a shuffle; all others are joined by a shuffle
on the pre-token after map-side counting. The sample decides only which way a pre-token takes, never a count.

Edge cases. Null and empty texts have 0 bytes and 0 tokens. Repeated rows and doc_ids each give their own row, null doc_ids too. Very long
pre-tokens are counted whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, durable
from .sentence_pieces import MARK, PieceTransducer

SAMPLE_ROWS, HOT_TOKENS, HOT_LENGTH = 20_000, 200_000, 24


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return PieceTransducer(path), sentencepiece.SentencePieceProcessor(model_file=path)


def count_pieces(pretokens: list[str], path: str) -> list[int]:
    """The library's piece count of each pre-token as it stands inside a text."""
    model, library = _model(path)
    # The library puts a word mark in front: a pre-token that starts with one is given without it.
    shown, less = [], []
    for p in pretokens:
        if p[:1] == MARK and len(p) > 1:
            shown.append(p[1:])
            less.append(0)
        elif p[:1] == MARK:
            shown.append("\n")
            less.append(len(library.encode("\n")) - 1)
        else:  # behind a line feed, with which nothing merges
            shown.append("\n" + p)
            less.append(len(library.encode("\n")))
    return [len(x) - y for x, y in zip(library.encode(shown, num_threads=1), less)]


def _frequencies(path: str):
    """Partial (pretoken, freq) of each task, let go every 500,000 entries."""

    def run(it):
        model, counts = _model(path)[0], Counter()
        for batch in it:
            for text in column_of(batch, "text").to_pylist():
                counts.update(model.pretoken.findall(model.normalise(text or "")))
                if len(counts) > 500_000:
                    yield _pairs(counts)
                    counts = Counter()
        yield _pairs(counts)

    return run


def _pairs(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pretoken", "freq"])


def _pieces(path: str):
    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count_pieces(batch.column(0).to_pylist(), path), pa.int64())], names=["pretoken", "n_pieces"])

    return run


def _per_document(path: str, hot):
    """Sum over hot pre-tokens, and the others with their frequency in the document."""

    def run(it):
        model, known = _model(path)[0], hot.value
        for big in it:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                sums, sizes, names, freqs, n_bytes = [], [0], [], [], []
                for text in column_of(batch, "text").to_pylist():
                    text = text or ""
                    total, before = 0, len(names)
                    for p, n in Counter(model.pretoken.findall(model.normalise(text))).items():
                        pieces = known.get(p)
                        if pieces is None:
                            names.append(p)
                            freqs.append(n)
                        else:
                            total += n * pieces
                    sums.append(total)
                    sizes.append(len(names) - before)
                    n_bytes.append(len(text.encode()))
                offsets = pa.array(np.cumsum(sizes, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [column_of(batch, "doc_id").cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(names, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(freqs, pa.int32()))],
                    names=["doc_id", "n_bytes", "hot_tokens", "names", "freqs"],
                )

    return run


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    rows = docs.count()
    sample = docs if rows <= SAMPLE_ROWS else docs.sample(SAMPLE_ROWS / rows, seed=10)
    hot = sample.mapInArrow(_frequencies(model_path), "pretoken string, freq long").where(F.length("pretoken") <= HOT_LENGTH)
    hot = hot.groupBy("pretoken").agg(F.sum("freq").alias("freq")).orderBy(F.desc("freq"), "pretoken").limit(HOT_TOKENS)
    hot = hot.select("pretoken").toArrow()["pretoken"].to_pylist()
    hot = spark.sparkContext.broadcast(dict(zip(hot, count_pieces(hot, model_path))))
    per_doc = docs.mapInArrow(_per_document(model_path, hot), "doc_id long, n_bytes long, hot_tokens long, names array<string>, freqs array<int>")
    # The row number is written down before anything depends on it.
    per_doc = durable(per_doc.withColumn("row", F.monotonically_increasing_id()), "pretokens")
    cold = per_doc.select("row", F.explode(F.arrays_zip("names", "freqs")).alias("x")).select("row", F.col("x.names").alias("pretoken"), F.col("x.freqs").alias("freq"))
    pieces = cold.select("pretoken").distinct().mapInArrow(_pieces(model_path), "pretoken string, n_pieces long")
    sums = cold.join(pieces, "pretoken").groupBy("row").agg(F.sum(F.col("freq") * F.col("n_pieces")).alias("cold_tokens"))
    out = per_doc.select("row", "doc_id", "n_bytes", "hot_tokens").join(sums, "row", "left")
    return out.select("doc_id", "n_bytes", (F.col("hot_tokens") + F.coalesce("cold_tokens", F.lit(0))).alias("n_tokens"))
