"""Benchmark decontamination: every passage of every document queries a BM25 index of the benchmark items.

Items are the indexed texts; a passage is `passage` words, every half of it. Items come in length classes: the class of an item is the smallest passage of
PASSAGE, 2 PASSAGE, 4 PASSAGE, ... words that is twice as long as the item, so that an item always fits into one, and a long item does not move the passages
of the others. Impacts are divided by the item's score with itself, so that one threshold serves all items. The number of items, their mean length and the
items that hold each term are counted once by Spark over the whole benchmark: a score depends on neither shards nor classes.

Block-max WAND: the items of a shard and class lie in blocks, and each term has its largest impact per block. The bounds of all blocks over a passage are
summed at once; in a block that reaches the threshold the posting lists are walked by pivot: lists are ordered by their next item, and items
before the first list at which the summed largest impacts reach the threshold are skipped. Every item at or above the threshold is retrieved, then
verified: the item's last sentence counts as its answer, the rest as its question, and the shares of their 5-word sequences that stand in the document
around the passage must both be high enough.

The index holds benchmark items only, in shards of at most SHARD_ITEMS items and SHARD_BYTES of text by expectation, broadcast one after the other and
released; a worker builds a shard's index once. Documents are never shuffled, and are read once a shard.

Edge cases. Null and empty documents match nothing; null and blank items are not indexed. Equal items are each reported. An item of one sentence gives its last
quarter as the answer. Repeated documents are each judged; rows without doc_id too. An empty table on either side gives an empty result. Long texts are passages
throughout. Other columns of either table are ignored, whatever their names. Of equal scores the earliest passage is reported.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column_of, durable, release, texts_of

K1, B = 1.2, 0.75
PASSAGE, SHARD_ITEMS, SHARD_BYTES, BLOCKS = 64, 20_000, 16 << 20, 50
THRESHOLD, QUESTION, ANSWER = 0.5, 0.8, 0.5
_SENTENCE = re.compile(rb"(?<=[.!?])\s+")


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def _grams(words: list[bytes], n: int) -> set[tuple]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def passage_length(words: int) -> int:
    """Words of the passages that an item of so many words is searched in."""
    n = PASSAGE
    while n < 2 * words:
        n *= 2
    return n


class ItemIndex:
    """BM25 impacts of items of one passage length, with their blocks' bounds. frequency, n, mean: of the whole benchmark; by default these items are all."""

    def __init__(self, items: list[tuple[int, bytes]], frequency: dict[bytes, int] | None = None, n: int | None = None, mean: float | None = None):
        self.items = [(i, w, t) for i, t in items if (w := tokens(t or b""))]
        own = Counter(t for _, w, _ in self.items for t in set(w))
        frequency = own if frequency is None else frequency
        n = n or max(len(self.items), 1)
        mean = mean or sum(len(w) for _, w, _ in self.items) / n
        self.size = max(4, -(-max(len(self.items), 1) // BLOCKS))
        self.term = {t: k + 1 for k, t in enumerate(own)}  # 0: a word that no item has
        self.bounds = np.zeros((len(own) + 1, -(-max(len(self.items), 1) // self.size)), np.float32)
        self.postings: dict[int, dict[bytes, list[tuple[int, float]]]] = defaultdict(lambda: defaultdict(list))
        for at, (_, w, _) in enumerate(self.items):
            impact = {t: np.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in Counter(w).items()}
            total, block = sum(impact.values()), at // self.size
            for t, x in impact.items():
                self.postings[block][t].append((at, x / total))
                self.bounds[self.term[t], block] = max(self.bounds[self.term[t], block], x / total)
        self.postings = {k: dict(v) for k, v in self.postings.items()}
        self.passage = max((passage_length(len(w)) for _, w, _ in self.items), default=PASSAGE)
        self.stride = self.passage // 2
        self.parts = [self._parts(t, w) for _, w, t in self.items]

    def wand(self, block: int, terms: set[bytes]):
        """(item, score) of the block's items at or above the threshold."""
        postings = self.postings[block]
        # [next item, largest impact, list, place], each list in order of items.
        lists = [[p[0][0], float(self.bounds[self.term[t], block]), p, 0] for t in terms if (p := postings.get(t))]
        limit = THRESHOLD * (1 - 1e-6)
        while lists:
            lists.sort(key=lambda x: x[0])
            bound = 0.0
            for pivot, x in enumerate(lists):
                bound += x[1]
                if bound >= limit:
                    break
            else:
                return
            item = lists[pivot][0]
            if lists[0][0] == item:
                hit = [x for x in lists if x[0] == item]
                score = sum(x[2][x[3]][1] for x in hit)
                if score >= limit:
                    yield item, score
                behind = item + 1
            else:
                hit, behind = lists[:pivot], item
            for x in hit:
                while x[3] < len(x[2]) and x[2][x[3]][0] < behind:
                    x[3] += 1
                x[0] = x[2][x[3]][0] if x[3] < len(x[2]) else -1
            lists = [x for x in lists if x[0] >= 0]

    @staticmethod
    def _parts(text: bytes, words: list[bytes]) -> list[tuple[int, set]]:
        """(n, n-word sequences) of the question and of the answer."""
        last = len(tokens(_SENTENCE.split(text.strip())[-1]))
        if last == len(words):
            last = max(1, len(words) // 4)
        question, answer = words[: len(words) - last] or words, words[len(words) - last :]
        return [(n := min(5, len(w)), _grams(w, n)) for w in (question, answer)]

    def search(self, words: list[bytes]):
        """(item, score, question overlap, answer overlap, passage start) of every verified item, best passage first."""
        if not words or not self.items:
            return []
        ids = np.fromiter(map(self.term.get, words, repeat(0)), np.int32, len(words))
        # Indexed terms of each half passage, every term once: a passage's bound is the sum of its halves' bounds.
        halves = -(-len(words) // self.stride)
        known = np.flatnonzero(ids)
        keys = np.unique(known // self.stride * len(self.bounds) + ids[known])
        half, term = keys // len(self.bounds), keys % len(self.bounds)
        present, first = np.unique(half, return_index=True)
        if not len(present):
            return []
        summed = np.zeros((halves + 1, self.bounds.shape[1]), np.float32)
        summed[present] = np.add.reduceat(self.bounds[term], first, axis=0)
        summed = summed[: max(halves - 1, 1)] + summed[1 : max(halves, 2)]
        found: dict[int, tuple] = {}
        # Sums of float32 bounds may fall below the exact score by rounding.
        for k, block in zip(*np.nonzero(summed >= THRESHOLD * (1 - 1e-5))):
            at = int(k) * self.stride
            for item, x in self.wand(int(block), set(words[at : at + self.passage])):
                if item not in found or x > found[item][0]:
                    near = words[max(0, at - self.stride) : at + self.passage + self.stride]
                    shares = [len(_grams(near, n) & g) / len(g) for n, g in self.parts[item]]
                    if shares[0] >= QUESTION and shares[1] >= ANSWER:
                        found[item] = (x, *shares, at)
        return [(self.items[i][0], *v) for i, v in found.items()]


_MATCHES = "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double, passage int"


#: The indexes that a worker built last, under their broadcast's key.
_BUILT: dict[str, list[ItemIndex]] = {}


def _indexes(shard) -> list[ItemIndex]:
    key, items, frequency, n, mean = shard.value
    if key not in _BUILT:
        classes = defaultdict(list)
        for i, t in items:
            classes[passage_length(len(tokens(t)))].append((i, t))
        _BUILT.clear()
        _BUILT[key] = [ItemIndex(x, frequency, n, mean) for _, x in sorted(classes.items())]
    return _BUILT[key]


def _searched(shard):
    def run(it):
        release("decontamination")
        indexes = _indexes(shard)
        for batch in it:
            rows = []
            for i, t in zip(column_of(batch, "doc_id").to_pylist(), texts_of(batch)):
                words = tokens(t)
                rows += [(i, *m) for index in indexes for m in index.search(words)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _MATCHES.split(", ")])

    return run


def _item_terms(it):
    """(item_id, words, terms): how many words an item has, and which."""
    for batch in it:
        found = [tokens(t) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([column_of(batch, "item_id").cast(pa.int64()), pa.array([len(w) for w in found], pa.int64()), pa.array([list(dict.fromkeys(w)) for w in found], pa.list_(pa.binary()))], names=["item_id", "words", "terms"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, bm25, question_overlap, answer_overlap, passage): a row for each item that a document holds; passage is its first word."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    terms = durable(items.mapInArrow(_item_terms, "item_id long, words long, terms array<binary>").where("words > 0"), "item-terms")
    total = terms.agg(F.count("*").alias("n"), F.avg("words").alias("mean")).first()
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total.n // SHARD_ITEMS), -(-n_bytes // SHARD_BYTES))
    spread = F.pmod(F.xxhash64("item_id"), F.lit(shards))
    counts = terms.select(F.explode("terms").alias("term"), spread.alias("shard"))
    frequency = counts.groupBy("term").agg(F.count("*").alias("f"), F.collect_set("shard").alias("shards"))
    frequency = durable(frequency.select("term", "f", F.explode("shards").alias("shard")), "item-frequencies")
    out = None
    for k in range(shards):
        rows = sorted((r.item_id, r.text.encode()) for r in items.where(spread == k).collect())
        own = {bytes(r.term): r.f for r in frequency.where(F.col("shard") == k).collect()}
        shard = spark.sparkContext.broadcast((uuid4().hex, rows, own, total.n, total.mean))
        found = docs.select("doc_id", "text").mapInArrow(_searched(shard), _MATCHES)
        if shards > 1:
            # Each shard's matches are written before the next shard is read, so that one is held at a time.
            found = durable(found, "matches")
            shard.unpersist()
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item. Rows without doc_id stay."""
    gone = durable(contaminated(docs, benchmark).where("doc_id is not null").select("doc_id").distinct(), "leaks")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti")
