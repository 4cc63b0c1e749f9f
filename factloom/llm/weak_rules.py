"""Quality rules by weak supervision: rules vote good, bad or abstain, and expectation-maximisation weighs them.

A document's statistics give one vote per rule. Votes are counted by pattern (at most 3 to the number of RULES patterns, whatever the input), the
EM runs on these counts: each rule's chance of each vote given a good or bad document and the share of good documents. A document is kept
when the posterior probability of its pattern being good is at least 0.5 and the base rules do not fail it.

Edge cases. Null and empty texts have no words: all counts 0, base_failed true, kept false. Repeated rows each count and each get a row. An empty
table gives an empty result. Very long texts are counted whole. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, durable, texts_of

_SYMBOLS = b"#*$%&|<>"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: (name, expression, bad from, good from, good up to). Most rules only know what is bad and abstain otherwise.
RULES = [
    ("symbols", "n_symbols / n_words", 0.3, None, None),
    ("repeats", "n_repeat_words / n_words", 0.2, None, None),
    ("lines", "n_dup_lines / greatest(n_lines, 1)", 0.3, None, None),
    ("upper", "n_upper / greatest(word_chars, 1)", 0.4, None, None),
    ("marks", "n_marks / n_words", 0.5, None, None),
    ("top", "n_top / n_words", 0.3, None, None),
    ("bars", "n_bars / n_words", 0.3, None, None),
    ("sentences", "n_stops / n_words", 0.9, 0.03, 0.5),
]


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that occur twice or more in the text."""
    grams = list(zip(*(words[i:] for i in range(window))))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    gone = np.zeros(len(words), bool)
    at = np.flatnonzero([counts[g] > 1 for g in grams])
    for i in range(window):
        gone[at + i] = True
    return int(gone.sum())


def counts_of(text: bytes) -> list[int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    solid = b"".join(words)
    continuation = len(solid) - len(solid.translate(None, bytes(range(0x80, 0xC0))))
    top = Counter(words).most_common(1)
    left = lambda chars: len(solid) - len(solid.translate(None, chars))
    return [len(words), len(solid) - continuation, left(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), left(bytes(range(65, 91))), left(b"!?"), top[0][1] if top else 0, left(b"|"), left(b".,")]


_SCHEMA = ", ".join(f"{c} long" for c in ["doc_id", *_COUNTS, "n_lines", "n_upper", "n_marks", "n_top", "n_bars", "n_stops"])


def _counted(it):
    for batch in it:
        rows = np.array([counts_of(t) for t in texts_of(batch)], np.int64).reshape(batch.num_rows, 11)
        yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id").cast(pa.int64()), *(pa.array(rows[:, i].copy()) for i in range(11))], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def vote(expression: str, bad: float, good_from: float | None, good_to: float | None) -> F.Column:
    """0 bad, 1 abstention, 2 good; without words a rule abstains."""
    x = F.expr(expression)
    out = F.when(F.col("n_words") == 0, 1).when(x >= bad, 0)
    return (out if good_from is None else out.when(x.between(good_from, good_to), 2)).otherwise(1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: the posterior of each pattern being good, P(vote | class) by rule, and the share of good documents."""
    n_rules = patterns.shape[1]
    # Before any evidence rules are right more often than wrong, and most documents are good.
    vote_given = np.tile(np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]])[:, None, :], (1, n_rules, 1))
    share, post = 0.8, np.zeros(len(patterns))
    for _ in range(rounds):
        logs = np.log(vote_given[:, np.arange(n_rules), patterns]).sum(axis=2) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        share = float(np.clip((post * counts).sum() / max(counts.sum(), 1), 0.01, 0.99))
        for k, weight in enumerate(((1 - post) * counts, post * counts)):
            for v in range(3):
                vote_given[k, :, v] = ((patterns == v) * weight[:, None]).sum(axis=0) + 1
            vote_given[k] /= vote_given[k].sum(axis=1, keepdims=True)
        if done:
            break
    return post, vote_given, share


def judged_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, good_probability) for each row of docs."""
    counted = docs.select("doc_id", "text").mapInArrow(_counted, _SCHEMA)
    pattern = sum((vote(*rule) * 3**i for i, (_, *rule) in enumerate(RULES)), F.lit(0))
    counted = durable(counted.withColumn("pattern", pattern.cast("int")), "votes")
    found = counted.groupBy("pattern").count().collect()
    ids = np.array([r.pattern for r in found], np.int64)
    votes = ids[:, None] // 3 ** np.arange(len(RULES)) % 3
    post, _, _ = estimate(votes.reshape(-1, len(RULES)), np.array([r["count"] for r in found], float))
    posterior = docs.sparkSession.createDataFrame([(int(i), float(p)) for i, p in zip(ids, post)], "pattern int, good_probability double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = counted.join(F.broadcast(posterior), "pattern").withColumn("base_failed", failed)  # at most 3 ** 8 rows
    return out.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.col("good_probability") >= 0.5)).alias("kept"), "good_probability")
