"""Substring deduplication: runs of words that also start earlier are taken out.

The dealt method, a greedy relative Lempel-Ziv parse, is replaced in its core (the README says why): the reference is all text that starts earlier (a
smaller doc_id, or the same document further left), and every 20-word window is judged against all of it, not against one chosen source. The index of
reference blocks is kept as the filter: content-chosen blocks, the smallest of the 8-word hashes inside each 20-word window (winnowing), so that equal
windows anywhere pick equal blocks. Spans are the runs of windows that are copied; each is at least one window (20 words) long.

1. Blocks are counted; those that occur once in the corpus are handed back to their documents, so that a hot block is only ever a
   counter with map-side combining and never a join key.
2. Windows around repeated blocks are hashed to 128 bits; the earliest start of every window is found the same way and handed back.
3. What is in step 2 and not earliest is copied text.

Edge cases. Null and blank texts have no words: nothing is removed, the kept text is empty. Texts shorter than a window stay whole. Rows that
repeat a doc_id count as one document (a window of one is not a copy of the same window of the other); rows without doc_id are
neither reference nor cleaned. Repeated rows of one id and ties in place keep the leftmost start. Very long texts are taken whole. An empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, column_of, durable, hashed_words, mix, rolling, texts_of

WINDOW, BLOCK = 20, 8
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _blocks(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a document's word hashes: the hash at every block start, and the block start that each window picks."""
    grams = mix(rolling(h, BLOCK, _BASES[0]))
    picks = sliding_window_view(grams, WINDOW - BLOCK + 1).argmin(axis=1) + np.arange(len(h) - WINDOW + 1)
    return grams, picks


def _chosen(it):
    memo = WordHashes()
    for big in it:
        for at in range(0, big.num_rows, 1024):
            batch = big.slice(at, 1024)
            ids = column_of(batch, "doc_id").to_pylist()
            h, starts = hashed_words([t.split() for t in texts_of(batch)], memo)
            hashes, docs, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                if b - a >= WINDOW and ids[i] is not None:
                    grams, picks = _blocks(h[a:b])
                    own = picks[np.append(True, picks[1:] != picks[:-1])]
                    hashes.append(grams[own])
                    docs.append(np.full(len(own), ids[i], np.int64))
                    places.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(places).astype(np.int32))], names=["block", "doc_id", "place"])


def _copyable(h: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Starts of the windows whose block is not single in the corpus."""
    picks = _blocks(h)[1]
    lone = np.zeros(len(h), bool)
    lone[single] = True
    return np.flatnonzero(~lone[picks])


def _windows(it):
    memo = WordHashes()
    for big in it:
        for at in range(0, big.num_rows, 512):
            batch = big.slice(at, 512)
            ids = column_of(batch, "doc_id").to_pylist()
            single = column_of(batch, "single")
            h, starts = hashed_words([t.split() for t in texts_of(batch)], memo)
            one, two, docs, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                if b - a >= WINDOW and ids[i] is not None:
                    own = _copyable(h[a:b], _list(single, i))
                    if len(own):
                        # Of equal windows in one document only the leftmost can be the earliest of all.
                        w1, left = np.unique(rolling(h[a:b], WINDOW, _BASES[0])[own], return_index=True)
                        own = own[left]
                        one.append(w1)
                        two.append(rolling(mix(h[a:b]), WINDOW, _BASES[1])[own])
                        docs.append(np.full(len(own), ids[i], np.int64))
                        places.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(mix(np.concatenate(one)).view(np.int64)), pa.array(np.concatenate(two).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(places).astype(np.int32))], names=["w1", "w2", "doc_id", "place"])


def _list(column: pa.ListArray, i: int) -> np.ndarray:
    value = column[i]
    return value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, np.int32)


def _parsed(it):
    memo = WordHashes()
    for big in it:
        for at in range(0, big.num_rows, 512):
            batch = big.slice(at, 512)
            ids, single, first = column_of(batch, "doc_id"), column_of(batch, "single"), column_of(batch, "first")
            docs = [t.split() for t in texts_of(batch)]
            h, starts = hashed_words(docs, memo)
            texts, n_words, n_removed, begins, lengths = [], [], [], [], []
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                words, gone, spans = docs[i], 0, []
                if b - a >= WINDOW and ids[i].is_valid:
                    copied = np.setdiff1d(_copyable(h[a:b], _list(single, i)), _list(first, i), assume_unique=True)
                    if len(copied):
                        # A factor ends where the next copied window starts beyond it: touching windows join.
                        cut = np.flatnonzero(np.diff(copied) > WINDOW)
                        spans = list(zip(copied[np.append(0, cut + 1)].tolist(), (copied[np.append(cut, len(copied) - 1)] + WINDOW).tolist()))
                        kept, at_word = [], 0
                        for x, y in spans:
                            kept += words[at_word:x]
                            gone, at_word = gone + y - x, y
                        words = kept + words[at_word:]
                texts.append(b" ".join(words))
                n_words.append(int(b - a))
                n_removed.append(gone)
                begins.append([x for x, _ in spans])
                lengths.append([y - x for x, y in spans])
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(begins, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32()))], names=["doc_id", "text", "n_words", "n_removed", "span_starts", "span_lengths"])


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, n_removed, span_starts, span_lengths): text is the kept words joined by one space."""
    docs = docs.select("doc_id", "text")
    blocks = docs.mapInArrow(_chosen, "block long, doc_id long, place int")
    lone = blocks.groupBy("block").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("place").alias("place")).where("n = 1")
    single = durable(lone.groupBy("doc_id").agg(F.collect_list("place").alias("single")), "single-blocks")
    with_blocks = docs.join(single, "doc_id", "left").select("doc_id", "text", "single")
    windows = with_blocks.mapInArrow(_windows, "w1 long, w2 long, doc_id long, place int")
    earliest = windows.groupBy("w1", "w2").agg(F.min_by("place", "doc_id").alias("place"), F.min("doc_id").alias("doc_id"))
    first = earliest.groupBy("doc_id").agg(F.collect_list("place").alias("first"))
    parsed = with_blocks.join(first, "doc_id", "left").select("doc_id", "text", "single", "first")
    return parsed.mapInArrow(_parsed, "doc_id long, text string, n_words long, n_removed long, span_starts array<int>, span_lengths array<int>")


def with_digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
