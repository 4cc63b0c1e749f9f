"""Toxicity: a lexicon trie intersected with Levenshtein automata finds misspelled terms; quotation marks tell quotation from abuse.

The lexicon is learned from at most LABEL_ROWS labelled rows: words and word stems that stand MIN_RATE times as often in the text of toxic documents as
in that of others, with a log-likelihood ratio of MIN_LLR or more; of a stem and its longer forms the one with the largest ratio is taken.
Each term has a strength: 2 where PRECISION of its documents are toxic, else 1 from STRONG_RATE on, else 0. The intersection is one lazily built deterministic automaton over the letters of a word: its states
are sets of (trie node, edits so far), so a word costs a table look-up per letter and dies early. Terms of 5 letters or more allow one
edit, of 9 or more two; a stem accepts words of its own length or more whose start is so near. A hit counts as quoted where the quotation marks before it are odd
in number and one follows, wherever they stand in the text, or where its own word has two; any other hit is in the open.
A logistic model over these sums and over the hits and hit density of each strength, fitted on the same bounded rows, gives the score.

Edge cases. Null and empty texts have no hits and get the score of a clean text. Without any toxic label the lexicon is empty and every score is the same. Repeated
rows are scored each. Labels that are null count as missing. An empty table gives an empty result; very long texts are read whole; of tied terms the shorter kind and
the first by letters is taken. Columns other than doc_id, text and toxic are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, durable, keep_ids, split_column

LABEL_ROWS, MIN_DOCS, PRECISION = 40_000, 8, 0.97
MIN_RATE, STRONG_RATE, MIN_LLR = 3, 12, 30
_TRIM = "\"'“”‘’«»„.,;:!?()[]{}*#$%&|<>-"
_QUOTE = re.compile("[\"“”«»„]")
_N = 12


def clean(word: str) -> str:
    return word.strip(_TRIM).lower()


class LexiconAutomaton:
    """terms: (text, is_stem). A stem accepts any ending, but no word shorter than itself."""

    def __init__(self, terms: list[tuple[str, bool]], strengths: list[int] | None = None):
        self.strengths = [2] * len(terms) if strengths is None else strengths
        self.child, self.term, self.room, self.lengths = [{}], [None], [0], [len(t) for t, _ in terms]
        for i, (text, stem) in enumerate(terms):
            edits = 2 if len(text) >= 9 else 1 if len(text) >= 5 else 0
            node = 0
            self.room[0] = max(self.room[0], edits)
            for c in text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                    self.room.append(0)
                node = self.child[node][c]
                self.room[node] = max(self.room[node], edits)
            self.term[node] = (*(self.term[node] or (None, None)), edits)
            self.term[node] = (self.term[node][0] if stem else i, i if stem else self.term[node][1], edits)
        self.states, self.numbers, self.moves, self.found = [], {}, [], []
        self.start = self._number({0: 0}) if terms else -1

    def _number(self, nodes: dict[int, int]) -> int:
        """The state of a set of trie nodes with their fewest edits, closed under skipped letters of a term."""
        stack = list(nodes)
        while stack:
            n = stack.pop()
            for m in self.child[n].values():
                e = nodes[n] + 1
                if e <= self.room[m] and e < nodes.get(m, 99):
                    nodes[m] = e
                    stack.append(m)
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(nodes)
            self.moves.append({})
            near = [(e, *self.term[n][:2]) for n, e in nodes.items() if self.term[n] and e <= self.term[n][2]]
            ends = [(e, word) for e, word, _ in near if word is not None]
            self.found.append((min(ends, default=None), sorted((e, stem, self.lengths[stem]) for e, _, stem in near if stem is not None)))
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for n, e in self.states[state].items():
            for d, m in self.child[n].items():
                cost = e + (d != c)
                if cost <= self.room[m] and cost < after.get(m, 99):
                    after[m] = cost
            if e + 1 <= self.room[n] and e + 1 < after.get(n, 99):
                after[n] = e + 1
        self.moves[state][c] = to = self._number(after)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, or None."""
        state = self.start
        if state < 0:
            return None
        best = None
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return best
            for e, stem, length in self.found[state][1]:
                if length <= len(word) and (best is None or e < best[0]):
                    best = e, stem
            if best and not best[0]:
                return best
        end = self.found[state][0] if word else None
        return min((x for x in (best, end) if x), default=None)


def context_scores(text: str, automaton: LexiconAutomaton, memo: dict) -> list[float]:
    words = text.split()
    hits = []
    for i, w in enumerate(words):
        m = memo.get(w, 0)
        if m == 0:
            if len(memo) > 300_000:
                memo.clear()
            m = memo[w] = automaton.match(clean(w))
        if m is not None:
            hits.append((i, m))
    if not hits:
        return [0.0] * _N
    quotes = [len(_QUOTE.findall(w)) for w in words]
    before = np.concatenate([[0], np.cumsum(quotes)])
    open_hits = quoted = fuzzy = 0.0
    terms, strong = set(), [0, 0, 0]
    for i, (edits, term) in hits:
        left, right = before[i], before[-1] - before[i + 1]
        if (left % 2 and right) or quotes[i] >= 2:
            quoted += 1
        else:
            strong[automaton.strengths[term]] += 1
            if edits:
                fuzzy += 1
            else:
                open_hits += 1
        terms.add(term)
    return [np.log1p(open_hits), np.log1p(fuzzy), np.log1p(quoted), np.log1p(len(terms)), float(open_hits > 0), min(1.0, 20 * (open_hits + fuzzy) / len(words)), *(np.log1p(n) for n in strong), *(min(1.0, 20 * n / len(words)) for n in strong)]


def _terms(it):
    """Of each task, for every word and stem of 4 to 7 letters: toxic and clean documents that hold it, and how often it stands in either kind. The empty term counts all words."""
    counts: dict[tuple[str, bool], list[int]] = {}
    for batch in it:
        for text, y in zip(column_of(batch, "text").to_pylist(), column_of(batch, "toxic").to_pylist()):
            seen: dict[tuple[str, bool], int] = {}
            for w, n in Counter(map(clean, (text or "").split())).items():
                if w:
                    for t in [("", False), *([(w, False)] if len(w) >= 4 else []), *((w[:k], True) for k in range(4, min(8, len(w))))]:
                        seen[t] = seen.get(t, 0) + n
            kind = 0 if y else 1
            for t, n in seen.items():
                c = counts.setdefault(t, [0, 0, 0, 0])
                c[kind] += 1
                c[2 + kind] += n
        if len(counts) > 400_000:
            yield _term_rows(counts)
            counts = {}
    yield _term_rows(counts)


def _term_rows(counts) -> pa.RecordBatch:
    numbers = [pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([s for _, s in counts], pa.bool_()), *numbers], names=["term", "stem", "hits", "misses", "n_toxic", "n_clean"])


def choose_terms(rows: list[tuple[str, bool, float]]) -> list[tuple[str, bool]]:
    """Of words and stems with their evidence, the strongest first: no stem beside its own longer forms. All of them are taken; their number is bounded by what stands in LABEL_ROWS rows."""
    chosen: list[tuple[str, bool]] = []
    stems: set[str] = set()
    starts: set[str] = set()
    for term, stem, _ in sorted(rows, key=lambda r: (-r[2], r[1], r[0])):
        if any(term[:k] in stems for k in range(4, len(term) + 1)) or (stem and term in starts):
            continue
        chosen.append((term, stem))
        starts.update(term[:k] for k in range(4, len(term) + 1))
        if stem:
            stems.add(term)
    return chosen


def learn_lexicon(labelled: DataFrame) -> tuple[list[tuple[str, bool]], list[int]]:
    """Terms from rows (text, toxic), and their strengths."""
    counts = labelled.mapInArrow(_terms, "term string, stem boolean, hits long, misses long, n_toxic long, n_clean long").groupBy("term", "stem").agg(*(F.sum(c).alias(c) for c in ("hits", "misses", "n_toxic", "n_clean")))
    counts = durable(counts.where((F.col("hits") >= MIN_DOCS) | (F.col("term") == "")), "terms")
    total = counts.where("term = ''").first()
    if total is None or not total.n_toxic:
        return [], []
    toxic, clean_words = float(total.n_toxic), float(max(1, total.n_clean))
    x, y = F.col("n_toxic").cast("double"), F.col("n_clean").cast("double")
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    both = (x + y) / (toxic + clean_words)
    rated = counts.where("term <> ''").withColumn("llr", 2 * (part(x, both * toxic) + part(y, both * clean_words))).withColumn("rate", x / toxic / ((y + 0.5) / clean_words))
    good = rated.where((F.col("rate") >= MIN_RATE) & (F.col("llr") >= MIN_LLR)).collect()
    strength = {(r.term, r.stem): 2 if r.hits >= PRECISION * (r.hits + r.misses) else int(r.rate >= STRONG_RATE) for r in good}
    terms = choose_terms([(r.term, r.stem, r.llr) for r in good])
    return terms, [strength[t] for t in terms]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), g)
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5, held_out_rest: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; rows whose crc32(doc_id) mod held_out_mod is held_out_rest teach nothing."""
    docs = docs.select("doc_id", "text")
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    known = known.where(split_column(known, held_out_mod) != held_out_rest)
    rows = known.count()
    if rows > LABEL_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(LABEL_ROWS / rows * (1 << 30)))
    known = durable(known, "labels")
    n = known.count()
    labelled = keep_ids(docs, known.select("doc_id"), "doc_id", n).join(F.broadcast(known) if n <= 2 * LABEL_ROWS else known, "doc_id")
    lexicon, strengths = learn_lexicon(labelled.select("text", "toxic"))

    def scored(it):
        automaton, memo = LexiconAutomaton(lexicon, strengths), {}
        for batch in it:
            x = [context_scores(t or "", automaton, memo) for t in column_of(batch, "text").to_pylist()]
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * _N)
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id").cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.array(x, np.float64).ravel()))], names=["doc_id", "x"])

    x = durable(docs.mapInArrow(scored, "doc_id long, x array<double>"), "contexts")
    fit = x.join(known, "doc_id").select("x", "toxic").toPandas()
    w = fit_logistic(np.array(fit["x"].tolist(), float).reshape(-1, _N), fit["toxic"].to_numpy(float)) if len(fit) else np.zeros(_N + 1)
    score = F.lit(float(w[-1]))
    for i in range(_N):
        score = score + F.col("x")[i] * float(w[i])
    out = x.select("doc_id", (split_column(x, held_out_mod) == held_out_rest).alias("held_out"), (1 / (1 + F.exp(-score))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
