"""BPE encoding and decoding of whole texts: distinct words of many documents are merged together in numpy rounds.

Texts are cut at white space into chunks, and chunks that the worker doesn't remember into words; these are laid end to end in one flat array of symbols. In each round
the keys of all neighbouring symbols are looked up by binary search in the model's sorted pair keys, every word takes its lowest rank, and all
places of that pair in the word are merged at once, left to right. Words without a pair left leave the array. Where a merge may make a pair of lower rank
than its own (a token that several merges can make), the word merges only its leftmost place in that round, as one merge at a time would. Words of more
than LONG symbols, whose rounds would each pass over the whole word, take their merges from a heap of (rank, place) instead, with the same result.

The normaliser (NFC, lower case for each code point) and the splitting rule are Python's own Unicode tables; a text with a code point that these
tables do not know yet is cut by the tokenizer's own rules. Special tokens inside a text are found first, as the library does by default.

Edge cases. Null and empty texts, and texts of white space, have no ids and decode to the empty text. Repeated rows and doc_ids each give their own row, null
doc_ids too. Ties: of equal ranks the leftmost pair is merged first. Very long texts and words are encoded whole. An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import column_of, hold

#: Symbols of a word up to which it takes part in the rounds.
LONG = 512
#: Rows taken together, and chunks of a worker's memo, after which a new generation begins.
ROWS, MEMO_CHUNKS = 512, 250_000
NONE = np.int64(1) << 40
#: The white space of the splitting rule, as a character class, and what only Python's str.split() takes for white space.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others for the code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


@lru_cache(maxsize=1)
def splitter() -> tuple[re.Pattern, re.Pattern]:
    """The splitting rule (contractions, runs of letters, single numerals, runs of anything else but white space), and code points that Python's tables don't know."""
    ranges: dict[str, list[str]] = {"L": [], "N": [], "Cn": []}
    for kind, run in groupby(range(sys.maxunicode + 1), key=lambda c: k if (k := unicodedata.category(chr(c))) == "Cn" else k[0]):
        if kind in ranges:
            run = list(run)
            ranges[kind].append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    letters, numerals, unknown = map("".join, ranges.values())
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numerals}]|[^{WHITE}{letters}{numerals}]+"), re.compile(f"[{unknown}]")


class WordBPE:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocabulary, merges, end = whole["model"]["vocab"], whole["model"]["merges"], whole["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.special = {t: i.to_bytes(4, "little") for t, i in special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        names = [""] * (1 + max(chain(vocabulary.values(), special.values())))
        for token, i in chain(vocabulary.items(), special.items()):
            names[i] = token
        self.names = pa.array(names, pa.large_string())
        self.letters = byte_letters()
        self.bytes_of = {x: b for b, x in enumerate(self.letters)}
        self.inner = np.array([vocabulary[x] for x in self.letters], np.int64)
        self.last = np.array([vocabulary[x + end] for x in self.letters], np.int64)
        self.size = np.int64(len(names))
        pairs = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges], np.int64)
        ranks = np.arange(len(pairs), dtype=np.int64)
        lowest = np.full(len(names), NONE)  # rank of the first merge that a token takes part in
        np.minimum.at(lowest, pairs[:, 0], ranks)
        np.minimum.at(lowest, pairs[:, 1], ranks)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], ranks[order], pairs[:, 2]
        self.at_once = lowest[self.made] > ranks
        self.chunks, self.older = {}, {}

    # -- words ---------------------------------------------------------------
    def split(self, chunk: str) -> list[str]:
        """Words of a text without special tokens."""
        if not chunk.isascii():
            if splitter()[1].search(chunk):
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
                return [bytes(map(self.bytes_of.__getitem__, w)).decode() for w, _ in words]
            # Lower case is taken code point by code point: no final sigma.
            chunk = unicodedata.normalize("NFC", chunk).replace("\u03a3", "\u03c3")
        return splitter()[0].findall(chunk.lower())

    def parts(self, chunk: str) -> list[str]:
        """Words and special tokens. A special token has brackets beside letters, as no word has."""
        if "<|" not in chunk:
            return self.split(chunk)
        return list(chain.from_iterable([p] if p in self.special else self.split(p) for p in self.special_split.split(chunk)))

    # -- merges --------------------------------------------------------------
    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed as little-endian 32-bit integers."""
        out: list = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.merged_by_heap(w)
        if not short:
            return out
        flat = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        sizes = np.array([len(words[i]) for i in short], np.int64)
        symbols, owner = self.inner[flat], np.repeat(np.arange(len(short)), sizes)
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[flat[ends]]
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.full(len(symbols), NONE)
            rank[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
            rank[np.r_[starts[1:], len(symbols)] - 1] = NONE
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            done = least == NONE
            if done.any():
                gone = np.repeat(done, lengths)
                packed, width = symbols[gone].astype("<u4").tobytes(), lengths[done] * 4
                for i, a, b in zip(owner[starts[done]].tolist(), np.cumsum(width).tolist(), width.tolist()):
                    out[short[i]] = packed[a - b : a]
                symbols, owner, rank = symbols[~gone], owner[~gone], rank[~gone]
                least, lengths = least[~done], lengths[~done]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            # Of places that overlap, every second one from the left.
            first = np.r_[True, np.diff(hit) > 1]
            hit = hit[(hit - hit[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]) % 2 == 0]
            one = ~self.at_once[rank[hit]]
            if one.any():
                hit = hit[~one | np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def merged_by_heap(self, word: bytes) -> bytes:
        flat = np.frombuffer(word, np.uint8)
        start = self.inner[flat]
        start[-1] = self.last[flat[-1]]
        rank = self.pair_ranks(start[:-1], start[1:])
        places = np.flatnonzero(rank < NONE)
        heap = list(zip(rank[places].tolist(), places.tolist()))
        heapify(heap)
        symbols, n = start.tolist(), len(word)
        now = rank.tolist() + [int(NONE)]
        after, before, made, none = list(range(1, n + 1)), list(range(-1, n - 1)), self.made.tolist(), int(NONE)
        known: dict[tuple[int, int], int] = {}

        def ranked(p: int) -> None:
            q = after[p]
            if q == n:
                now[p] = none
                return
            pair = symbols[p], symbols[q]
            r = known.get(pair)
            if r is None:
                r = known[pair] = int(self.pair_ranks(np.array(pair[:1]), np.array(pair[1:]))[0])
            now[p] = r
            if r < none:
                heappush(heap, (r, p))

        while heap:
            r, p = heappop(heap)
            if now[p] != r:
                continue
            q = after[p]
            symbols[p], symbols[q], now[q], after[p] = made[r], -1, none, after[q]
            if after[p] < n:
                before[after[p]] = p
            ranked(p)
            if before[p] >= 0:
                ranked(before[p])
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()

    # -- texts ---------------------------------------------------------------
    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of these chunks. Two generations: what is used again outlives the older one."""
        if len(self.chunks) > MEMO_CHUNKS:
            self.chunks, self.older = {}, {c: x for c, x in self.chunks.items() if len(c) <= 48}
        new = {}
        for c in chunks:
            packed = self.older.get(c)
            if packed is None:
                new[c] = self.parts(c)
            else:
                self.chunks[c] = packed
        words = list(set().union(*new.values()).difference(self.special))
        ids = self.special | dict(zip(words, self.merged([w.encode() for w in words])))
        for c, parts in new.items():
            self.chunks[c] = b"".join(map(ids.__getitem__, parts))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text. Texts are cut at white space; no word and no special token spans it, and nothing composes with it."""
        cut = re.compile(f"[^{WHITE}]+").findall
        docs = [(cut(t) if SEPARATORS.search(t) else t.split()) if t else [] for t in texts]
        found, missed = [list(map(self.chunks.get, d)) for d in docs], set()
        for d, f in zip(docs, found):
            if None in f:
                missed.update(c for c, x in zip(d, f) if x is None)
        self.learn(missed)
        known = self.chunks
        return [b"".join([known[c] if x is None else x for c, x in zip(d, f)] if None in f else f) for d, f in zip(docs, found)]

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """Text of each list of ids, as the library makes it: this kind of tokenizer has no decoder, so tokens are joined by spaces, word ends and special tokens shown. Null gives the empty text."""
        tokens = pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values))
        return pc.binary_join(tokens, pa.scalar(" ", pa.large_string())).fill_null("")


@lru_cache(maxsize=2)
def bpe_model(path: str) -> WordBPE:
    return WordBPE(path)


def _slices(it):
    for big in it:
        for at in range(0, big.num_rows, ROWS):
            yield big.slice(at, ROWS)


def _encoded(path: str):
    def run(it):
        model = bpe_model(path)
        hold("bpe", bpe_model.cache_clear)
        for batch in _slices(it):
            packed = model.encode_batch(column_of(batch, "text").to_pylist())
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id").cast(pa.int64()), pa.array(sizes), ids], names=["doc_id", "n_tokens", "ids"])

    return run


def _decoded(path: str):
    def run(it):
        model = bpe_model(path)
        for batch in _slices(it):
            texts = model.decode_batch(column_of(batch, "ids"))
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id").cast(pa.int64()), texts.cast(pa.string())], names=["doc_id", "text"])

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row of docs, in one pass without a shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_encoded(path), "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). A null list gives the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, text string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs: encoded, decoded again from the ids, and both hashed inside one task."""

    def run(it):
        for batch in _encoded(path)(it):
            ids = column_of(batch, "ids")
            flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            packed = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]
            (texts,) = _decoded(path)(iter([batch]))
            decoded = [hashlib.sha256(t).hexdigest() for t in column_of(texts, "text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), column_of(batch, "n_tokens"), pa.array(packed), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
