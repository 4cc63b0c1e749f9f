"""SentencePiece encoding and decoding as a weighted finite-state transducer.

compile_model() turns a model file into transducers over characters. The normaliser has one state: an arc from a space to the word mark, an arc
from every other character to itself, and one arc from nothing to the mark in front. The piece transducer has an arc for every piece, found along a
trie of their characters, and byte fallback: from every character outside the alphabet an arc that writes its UTF-8 bytes as byte pieces.
Composed with an input, a state is (position, last piece). Arcs carry weights of the tropical semiring: for a unigram model the negated piece score
(fallback costs more than any piece); for a BPE model 0 if the piece may follow the last one and infinity if not, fallback 0. Two pieces may follow one
another exactly if merging their joined text by score gives them back; a sequence whose neighbours all may is what the merges give for the
whole text, so that the path of weight 0 is unique and a state needs to remember one piece only; behind a fallback arc there is no last piece. encode()
composes the transducers with an input and takes the shortest path.

The input is composed pre-token by pre-token: no piece spans a word mark that follows another character, so the shortest path of a
text is the chain of its pre-tokens' paths, and a path found once serves every repetition. So does the proof that its pieces spell the pre-token: a document
round-trips if all its pre-tokens do, since decoding puts the surfaces of pieces one behind the other.

Edge cases. Null and empty texts have no ids. The word mark itself in a text counts as a space, as in the library, and decodes to one. Repeated rows are
encoded each, rows without doc_id too; an empty table gives an empty result; very long texts are encoded whole; other columns are ignored, whatever their
names. Ties between paths of a unigram model go to the shorter first piece.
Only the identity normaliser without white-space removal is compiled; other models raise ValueError.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import MEMO_WORDS, column_of, hold, release

MARK = "▁"
#: Pre-tokens of a generation of remembered paths.
PATHS = 400_000
_INF = float("inf")


class PieceTransducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only the identity normaliser is supported")
        self.dummy = norm.add_dummy_prefix
        self.bpe = model.trainer_spec.model_type == model.trainer_spec.BPE
        kinds = model_pb2.ModelProto.SentencePiece
        self.pieces = [p.piece for p in model.pieces]
        self.score = [p.score for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p: self.score[i] for p, i in self.ids.items()}
        self.byte_ids = [0] * 256
        surface: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                surface.append(bytes([int(p.piece[3:5], 16)]))
            else:
                surface.append(b"" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ").encode())
        self.surface = surface
        if not any(self.byte_ids):
            raise ValueError("the model has no byte fallback")
        #: The trie of the pieces: every prefix, with the id of the piece that ends there or -1.
        self.trie = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.alphabet = {c for p in self.ids for c in p}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece spans a word mark")
        #: A line feed outside the alphabet is a border as well.
        feed = "" if "\n" in self.alphabet else "\n"
        self.pretoken = re.compile(f"[{feed}]+|{MARK}*[^{MARK}{feed}]+|{MARK}+" if feed else f"{MARK}*[^{MARK}]+|{MARK}+")
        self._follows: dict[int, bool] = {}
        #: Arcs of the normaliser that change a character, and what it writes first.
        self.arcs, self.first = {" ": MARK}, MARK if self.dummy else ""
        #: Weight of a fallback arc.
        self.fallback = 0.0 if self.bpe else max(0.0, -min(self.scores.values(), default=0.0)) + 10.0

    # -- normaliser -------------------------------------------------------
    def normalise(self, text: str) -> str:
        """The normaliser's output for an input: its only path. Its arcs write no character that another of them reads, so they may be run one after the other."""
        if not text:
            return ""
        for read, written in self.arcs.items():
            text = text.replace(read, written)
        return self.first + text

    # -- constraint between neighbours of a BPE path ----------------------
    def _merged(self, text: str) -> list[int]:
        """What merging by score gives for a short text inside the alphabet; the leftmost of equal scores merges first."""
        parts, scores = list(text), self.scores
        joint = [scores.get(x + y, -_INF) for x, y in zip(parts, parts[1:])]
        while joint and (best := max(joint)) > -_INF:
            k = joint.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joint[k]
            if k:
                joint[k - 1] = scores.get(parts[k - 1] + parts[k], -_INF)
            if k < len(joint):
                joint[k] = scores.get(parts[k] + parts[k + 1], -_INF)
        return [self.ids[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """a < 0: nothing comes before b."""
        key = a << 32 | b
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > 2 * MEMO_WORDS:
                self._follows.clear()
            before = self.pieces[a] if a >= 0 else ""
            known = self._follows[key] = self._merged(before + self.pieces[b]) == ([a, b] if a >= 0 else [b])
        return known

    # -- composition and shortest path ------------------------------------
    def shortest_path(self, text: str) -> list[int]:
        """Ids of the path of least weight through the piece transducer composed with a normalised text."""
        n = len(text)
        # Of each position: least weight, last piece of that path (-1: none), where its last arc began, whether that was a fallback arc.
        weight, last, back, fell = [_INF] * (n + 1), [-1] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        weight[0] = 0.0
        trie, bpe, score, follows, alphabet = self.trie.get, self.bpe, self.score, self._follows.get, self.alphabet
        for i in range(n):
            w = weight[i]
            if w == _INF:
                continue
            if text[i] not in alphabet and w + self.fallback < weight[i + 1]:
                weight[i + 1], last[i + 1], back[i + 1], fell[i + 1] = w + self.fallback, -1, i, True
            before = last[i]
            for j in range(i + 1, n + 1):
                piece = trie(text[i:j])
                if piece is None:
                    break
                if piece < 0:
                    continue
                if bpe:
                    if not weight[j]:
                        continue  # no path is lighter than one of weight 0
                    may = follows(before << 32 | piece)
                    step = 0.0 if (self.may_follow(before, piece) if may is None else may) else _INF
                else:
                    step = -score[piece]
                if w + step < weight[j]:
                    weight[j], last[j], back[j], fell[j] = w + step, piece, i, False
        arcs = []
        while n:
            arcs.append([self.byte_ids[b] for b in text[n - 1].encode()] if fell[n] else [last[n]])
            n = back[n]
        return list(chain.from_iterable(arcs[::-1]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.shortest_path(p) for p in self.pretoken.findall(self.normalise(text))))

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


class _Paths(dict):
    """Pre-token to its path as packed ids, found once and remembered. Two generations of `size` entries: what is used again outlives the older one. Long
    pre-tokens are not kept. `lost` are those that their pieces do not spell."""

    def __init__(self, model: PieceTransducer, size: int):
        super().__init__()
        self.model, self.size, self.older, self.lost = model, size, {}, set()

    def __missing__(self, pretoken: str) -> bytes:
        packed = self.older.get(pretoken)
        if packed is None:
            path = self.model.shortest_path(pretoken)
            if b"".join(map(self.model.surface.__getitem__, path)) != pretoken.replace(MARK, " ").encode():
                self.lost.add(pretoken)
            packed = array("i", path).tobytes()
        if len(pretoken) <= 48:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[pretoken] = packed
        return packed


@lru_cache(maxsize=2)
def _paths(path: str, size: int) -> _Paths:
    return _Paths(PieceTransducer(path), size)


def compile_model(path: str) -> PieceTransducer:
    return _paths(path, PATHS).model


def _encoder(path: str, size: int = PATHS):
    def run(it):
        release("sentence pieces")
        memo = _paths(path, size)
        hold("sentence pieces", _paths.cache_clear)
        model = memo.model
        for big in it:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                sizes, flat, same = [0], [np.zeros(0, np.int32)], []
                for text in column_of(batch, "text").to_pylist():
                    parts = model.pretoken.findall(model.normalise(text)) if text else []
                    ids = b"".join(map(memo.__getitem__, parts))
                    flat.append(np.frombuffer(ids, np.int32))
                    sizes.append(len(ids) // 4)
                    same.append(not memo.lost or memo.lost.isdisjoint(parts))
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id").cast(pa.int64()), pa.array(sizes[1:], pa.int64()), ids, pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "round_trip"])

    return run


def encode_documents(docs: DataFrame, model_path: str, remembered: int = PATHS) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) for each row of docs; round_trip tells that decoding the ids gives the text back.

    One pass over the rows without a shuffle: no row depends on another one. A worker remembers the paths of up to twice `remembered` pre-tokens (about 265 bytes each); fewer only
    take more time.
    """
    return docs.select("doc_id", "text").mapInArrow(_encoder(model_path, remembered), "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). A null list gives an empty text."""

    def run(it):
        model = compile_model(model_path)
        for batch in it:
            texts = [model.decode(x or []) for x in column_of(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
