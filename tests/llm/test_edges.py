"""Repeated ids, empty tables, clashing columns, null ids and very long texts, and plain versions of operators that SQL cannot express."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import decontamination, line_dedup, linking, lm_mixing, near_dedup, quality_classifier, sentence_pieces, substring_dedup, token_counts, toxicity, weak_rules
from factloom.llm.queries import piece_model
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, held_out string, n_words string, places string, node string, ids string, predicted string"
LONG = "word " * 400_000 + "x" * 300_000


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 60))) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "other text\nof the same id"), (3, texts[3]), (None, texts[5]), (50, None), (51, ""), (52, LONG), (53, LONG)]
    return spark.createDataFrame([(i, t, "en", None, 1, *["clash"] * 7) for i, t in rows], SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0), "clash") for i in range(20)] + [(None, 1, 1, "x"), (5, None, None, "x"), (5, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")


def operators(labels, bench):
    return {
        "pieces": lambda d: sentence_pieces.encode_documents(d, piece_model()), "contaminated": lambda d: decontamination.contaminated(d, bench), "quality": lambda d: quality_classifier.quality_scores(d, labels),
        "spans": substring_dedup.remove_repeated_spans, "toxicity": lambda d: toxicity.toxicity_scores(d, labels), "rules": weak_rules.judged_documents, "near": near_dedup.near_duplicate_groups,
        "lm": lm_mixing.lm_scores, "lines": lambda d: line_dedup.remove_repeated_lines(d, 1), "tokens": lambda d: token_counts.token_counts(d, piece_model()),
    }


@pytest.mark.parametrize("name", ["pieces", "contaminated", "quality", "spans", "toxicity", "rules", "near", "lines", "tokens", "lm"])
def test_odd_tables(spark, odd, labels, name):
    bench = spark.createDataFrame([(1, "a b c d e f g h one two three. four five", "clash"), (2, None, "x"), (None, "a b c", "x"), (3, " ", "x")], "item_id long, text string, doc_id string")
    run = operators(labels, bench)[name]
    assert run(odd.limit(0)).count() == 0
    got = run(odd).collect()
    assert name == "contaminated" or len(got) == odd.count()
    if name != "contaminated":
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert run(odd.where("doc_id = 51")).count() == (0 if name == "contaminated" else 1)


def test_no_labels_and_no_benchmark(spark, odd, labels):
    assert {r.score for r in quality_classifier.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity_scores(odd, labels.limit(0)).count() == odd.count()
    assert decontamination.contaminated(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_near_dedup_judges_rows_of_one_id_by_their_texts(spark):
    w, v = "the old mill by the river stood still all summer long", "a quite different text about trains and bridges in snow"
    docs = spark.createDataFrame([(3, w), (5, w), (5, v), (9, v), (None, w)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicate_groups(docs, 2, 80).collect())
    assert got == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False)]


def test_line_dedup_with_repeated_ids_and_short_lines(spark):
    line = "a line that is long enough to be compared with others by eight bytes, and then some"
    docs = spark.createDataFrame([(1, f"a\nb\nc\n{line}"), (1, "short"), (2, line.replace("others", "athers")), (3, "b\nshort\n\nnew")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup.remove_repeated_lines(docs, 1).collect())
    assert got == [(1, f"a\nb\nc\n{line}", 0), (1, "short", 0), (2, "", 1), (3, "\nnew", 2)]


def plain_lines(rows):
    """Groups of lines by all pairs, then what stays."""
    lines = [(i, n, line_dedup.normal(x)) for i, t in rows if i is not None for n, x in enumerate((t or "").encode().split(b"\n")) if line_dedup.normal(x)]
    texts = sorted({x for _, _, x in lines})
    parent = {x: x for x in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def alike(a, b, n):
        s, t = ({x[i : i + n] for i in range(len(x) - n + 1)} for x in (a, b))
        return 100 * len(s & t) >= 80 * len(s | t)

    for i, a in enumerate(texts):
        for b in texts[:i]:
            short = all(line_dedup.SHORT_SHINGLE <= len(x) <= line_dedup.SHORT_CHARS for x in (a, b))
            wide = all(len(x) >= line_dedup.LONG_CHARS for x in (a, b))
            if (short and alike(a, b, line_dedup.SHORT_SHINGLE)) or (wide and alike(a, b, line_dedup.SHINGLE)):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for i, n, x in lines:
        first[find(x)] = min(first.get(find(x), (i, n)), (i, n))
    return {(i, n) for i, n, x in lines if first[find(x)] != (i, n)}


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij klmnop") for _ in range(rng.choice((2, 6, 30, 60, 75, 90, 100, 160, 300)))) for _ in range(40)]

    def changed(x):
        x = list(x)
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        return "".join(x)

    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    got = {(r.doc_id, p) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect() for p in r.places}
    assert got == plain_lines(rows)


def test_signatures_rarely_miss():
    rng = np.random.default_rng(5)
    for low, high, n, bands in ((40, 96, 4, line_dedup.short_bands), (100, 300, 8, line_dedup.long_bands)):
        a, b = [], []
        while len(a) < 1500:
            x = bytearray(rng.integers(97, 123, int(rng.integers(low, high))).astype(np.uint8).tobytes())
            y = bytearray(x)
            for _ in range(int(rng.integers(1, 5))):
                y[int(rng.integers(0, len(y)))] = 65
            s, t = ({bytes(z[i : i + n]) for i in range(len(z) - n + 1)} for z in (x, y))
            if 0.8 <= len(s & t) / len(s | t) < 0.86:
                a.append(bytes(x))
                b.append(bytes(y))
        assert (bands(a) == bands(b)).any(axis=1).sum() >= 1497


def test_known_shared_keys_reach_all_members(spark):
    """A key that many nodes of one task share is dealt evenly, and still all of its nodes are members."""
    rows = [(i, [7, 100 + i]) for i in range(300)] + [(1000, [7]), (1001, [5, 6]), (1002, [6])]
    pairs, members = linking.shared_buckets(spark.createDataFrame(rows, "node long, bands array<long>").repartition(3), "t")
    assert {r.node for r in members.where("key = 7").collect()} == {*range(300), 1000} and members.where("n <> 301").count() == 0
    assert {(r.a, r.b) for r in pairs.collect()} == {(1001, 1002)}


def test_bm25_search_equals_scoring_every_item():
    rng = random.Random(9)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).encode()
    items = [(k, text(rng.randint(6, 40)) + b". " + text(5)) for k in range(300)]
    index = decontamination.ItemIndex(items)
    frequency = Counter(t for _, x in items for t in set(decontamination.tokens(x)))
    mean = sum(len(decontamination.tokens(x)) for _, x in items) / len(items)
    hits = 0
    for _ in range(30):
        words = decontamination.tokens(text(60) + b" " + items[rng.randrange(300)][1] + b" " + text(rng.randint(0, 120)))
        want = {}
        for at in range(0, max(len(words) - index.stride, 1), index.stride):
            passage = set(words[at : at + index.passage])
            for k, x in items:
                w = Counter(decontamination.tokens(x))
                impact = {t: math.log(1 + (len(items) - frequency[t] + 0.5) / (frequency[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * w.total() / mean)) for t, f in w.items()}
                score = sum(v for t, v in impact.items() if t in passage) / sum(impact.values())
                if score >= decontamination.THRESHOLD:
                    near = words[max(0, at - index.stride) : at + index.passage + index.stride]
                    shares = [len(decontamination._grams(near, n) & g) / len(g) for n, g in index.parts[k]]
                    if shares[0] >= decontamination.QUESTION and shares[1] >= decontamination.ANSWER:
                        want[k] = max(want.get(k, 0), score)
        got = {k: x for k, x, *_ in index.search(words)}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-5) for k in got)
        hits += len(want)
    assert hits >= 30


def test_scores_do_not_depend_on_shards_or_on_long_items(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(f"v{rng.randrange(500)}" for _ in range(n))
    items = [(k, text(20) + ". " + text(5)) for k in range(40)]
    docs = spark.createDataFrame([(k, f"{text(50)} {items[k][1]} {text(80)}") for k in range(0, 40, 4)] + [(100, text(300))], "doc_id long, text string")
    found = lambda rows: {(r.doc_id, r.item_id, round(r.bm25, 5), r.passage) for r in decontamination.contaminated(docs, spark.createDataFrame(rows, "item_id long, text string")).collect()}
    whole = found(items)
    assert {(d, i) for d, i, *_ in whole} == {(k, k) for k in range(0, 40, 4)}
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", 7)
    assert found(items) == whole
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", 20_000)
    with_long = found([*items, (99, text(20_000))])
    assert {(d, i, p) for d, i, _, p in with_long} == {(d, i, p) for d, i, _, p in whole}


def test_ridge_equals_one_solve(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "$$", "Gamma.", "so so"]) for _ in range(rng.randint(1, 60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.quality_scores(docs, labels).collect()}
    x = np.array([quality_classifier.statistics(t.encode()) for _, t in rows])
    train, y = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows]), np.array([i % 3 > 0 for i, _ in rows], float)
    mean, std = x[train].mean(axis=0), np.maximum(x[train].std(axis=0), 1e-6)
    z = quality_classifier._cosines(x, mean, std)
    a = z[train]
    weights = np.linalg.solve(a.T @ a + quality_classifier.RIDGE * len(a) / quality_classifier.FEATURES * np.eye(a.shape[1]), a.T @ y[train])
    raw = z @ weights
    bins = np.floor(np.clip(raw[train], -0.5, 1.5) * (quality_classifier.BINS / 2))
    cells = [(raw[train][bins == b].mean(), y[train][bins == b].sum(), (bins == b).sum()) for b in np.unique(bins)]
    xs, ys = quality_classifier.isotonic(*map(list, zip(*cells)))
    assert np.allclose([got[i] for i, _ in rows], np.interp(raw, xs, ys), atol=1e-5)


def test_rule_counts_of_lines_and_symbols(spark):
    texts = ["a b\na b\n\n c\nc\n#$%", "", "x\ty #|<>&*", "line\nline\nline\nline"]
    got = {r.doc_id: (r.n_symbols, r.n_dup_lines) for r in weak_rules.judged_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (3, 1), 1: (0, 0), 2: (6, 0), 3: (0, 3)}


def test_fan_in_of_shares(spark, monkeypatch):
    rows = [(i, "good words here . " * (i % 9 + 1) if i % 2 else "# # " * (i % 7 + 1)) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(9), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    one = {r.doc_id: r.score for r in quality_classifier.quality_scores(docs, labels).collect()}
    monkeypatch.setattr(quality_classifier, "FAN_IN", 2)
    two = {r.doc_id: r.score for r in quality_classifier.quality_scores(docs, labels).collect()}
    assert all(math.isclose(one[i], two[i], abs_tol=1e-6) for i in one)


def test_long_texts_in_spans_equal_brute_force(spark):
    rng = random.Random(8)
    passage = " ".join(str(rng.randrange(50)) for _ in range(90))
    rows = [(i, f"{' '.join(str(rng.randrange(9000)) for _ in range(rng.choice((5, 400, 9000))))} {passage if i % 2 else ''} end{i}") for i in range(12)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.with_digest(substring_dedup.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == brute.repeated_spans(rows)
