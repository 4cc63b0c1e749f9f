import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from factloom.llm import decontamination, line_dedup, linking, lm_mixing, near_dedup, quality_classifier, sentence_pieces, substring_dedup, token_counts, toxicity, weak_rules
from factloom.llm.queries import piece_model
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def some_texts(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        if i % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if i % 5 == 1 and out:
            words = out[rng.randrange(len(out))].split()
            if len(words) > 12:
                words[rng.randrange(len(words))] = "changed"
        out.append((" " if i % 3 else "\n").join(words))
    return out + ["", " \t\n ", "one", "one two", "One Two", "x" * 5000, " ".join(["again"] * 400)]


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(some_texts())] + [(1000, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 1, "clash") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_for(spark, rows):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")


def test_substring_dedup_equals_brute_force(docs, rows, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.with_digest(substring_dedup.remove_repeated_spans(docs)).collect()}
    assert got == brute.repeated_spans(rows)
    assert substring_dedup.remove_repeated_spans(empty).count() == 0


def test_overlaps_equal_plain_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000)).astype(np.uint64)) for _ in range(12)]
    a, b = np.nonzero(~np.eye(12, dtype=bool))
    assert linking.shared(sets, a, b).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]


def test_near_dedup_equals_brute_force(docs, rows, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicate_groups(docs, 2, 80).collect()}
    assert got == brute.near_groups(rows)
    assert near_dedup.near_duplicate_groups(empty).count() == 0


def test_large_bucket_gives_every_link(spark):
    """Two chains in one bucket: links are found whatever the pivots are."""
    n = linking.SMALL_BUCKET * 2
    signatures = spark.createDataFrame([(i, [7]) for i in range(n)], "node long, bands array<long>")
    pairs, members = linking.shared_buckets(signatures, "t")
    # Neighbours of one parity share eight of ten members, others fewer or none.
    sets = spark.createDataFrame([(i, 9, np.arange(i % 2 * 10**6 + i // 2, i % 2 * 10**6 + i // 2 + 9, dtype=np.uint64).tobytes()) for i in range(n)], "node long, n long, payload binary")
    comps = linking.link(pairs, members, sets, 80, lambda x: np.frombuffer(x, np.uint64), "t")
    assert {r.node: r.component for r in comps.collect()} == {i: i % 2 for i in range(n)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(5, 9), (9, 5), (3, 3)], "a long, b long")
    got = {r.node: r.component for r in linking.connected_components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 5: 5, 9: 5}


def test_pieces_equal_the_library_and_round_trip(docs, rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    encoded = sentence_pieces.encode_documents(docs, piece_model())
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: library.encode(t or "") for i, t in rows}
    assert encoded.where("not round_trip").count() == 0
    back = {r.doc_id: r.text for r in sentence_pieces.decode_documents(encoded, piece_model()).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_pieces_of_odd_strings():
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=piece_model()), sentence_pieces.compile_model(piece_model())
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("aeinrst .,é  \n▁\t09日本🎉́ß<>-'") for _ in range(rng.randint(0, 30)))
        assert model.encode(text) == library.encode(text)


def test_token_counts_equal_the_library(docs, rows, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, piece_model()).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows}
    assert token_counts.token_counts(empty, piece_model()).count() == 0


def test_line_dedup_keeps_one_line_of_each_group(spark):
    base = "this is a rather long line of text that stands in more than one document here, and it goes on for a while so that one letter counts little in it"
    near, far = base.replace("rather", "rathor"), "another line that has nothing at all to do with the other line of the text"
    rows = [(3, base + "\nshort\n" + far), (1, near + "\nshort"), (2, base + "\n" + base), (4, None), (5, ""), (None, base)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.places) for r in line_dedup.remove_repeated_lines(spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, places string").withColumnRenamed("places", "places")).toDF("doc_id", "text", "places", "n_lines", "n_removed").collect()}
    assert got == {3: ("short\n" + far, 3, 1, "own"), 1: (near + "\nshort", 2, 0, "own"), 2: ("", 2, 2, "own"), 4: ("", 0, 0, "own"), 5: ("", 0, 0, "own"), None: (base, 1, 0, "own")}


def test_line_dedup_finds_candidate_lines_by_their_hash(spark):
    """Every candidate passes the filter and few other lines do, so that texts are not dealt to find them."""
    random_ = np.random.default_rng(3).integers(0, 2**64, 40_000, dtype=np.uint64)
    bits = line_dedup.filter_of(spark.createDataFrame([(x,) for x in random_[:2_000].view(np.int64).tolist()], "node long"))
    assert line_dedup.passing(bits, random_[:2_000]).all() and line_dedup.passing(bits, random_[2_000:]).mean() < 0.03
    lines = [b"aaaaaaaa", b"abcdefgh" * 9, b"the harbour wall was painted white again"]
    for shingle in (4, 8):
        assert line_dedup._set_sizes(lines, shingle).tolist() == [len(line_dedup._shingles(bytes([shingle]) + x)) for x in lines]
    assert line_dedup.filter_of(spark.createDataFrame([], "node long")).sum() == 0


def test_line_dedup_of_short_lines(spark):
    """Exact repeats at any length, and one changed letter from 40 bytes on; blank lines stay."""
    lines = ["the harbour wall was painted white again", "a slow train left the valley before the first snow fell", "seven painters came to the old mill by the river and stayed there all summer"]
    rows = [(1, "\n".join(["All rights reserved.", "ok", "", *lines])), (2, "\n".join(["all  rights reserved.", "ok", "", *(x[:20] + "#" + x[21:] for x in lines), "only here"]))]
    left = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=1)
    assert {r.doc_id: (r.text, r.n_removed) for r in left.collect()} == {1: (rows[0][1], 0), 2: ("\nonly here", 5)}


def test_decontamination_finds_whole_items_only(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(6))) for k in range(60)] + [(90, None), (91, " ")]
    noise = lambda n: " ".join(word() for _ in range(n))
    rows = [(1, f"{noise(200)} {items[7][1].upper()} {noise(90)}"), (2, noise(500)), (3, None), (4, ""), (5, items[3][1]), (6, " ".join(items[9][1].split()[:8]) + noise(50)), (None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == {(1, 7), (5, 3), (None, 0)}
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()} == {2, 3, 4, 6, None}
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_quality_scores_learn_and_calibrate(spark, empty):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "so"]) + rng.choice(["", ",", "."]) for _ in range(80))
    rows = [(i, good() if i % 4 else "$$$ ### !!! " * 20) for i in range(300)] + [(900, None), (901, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), labels_for(spark, rows[:300])
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert all(r.predicted == int(r.doc_id % 4 != 0) for r in got if r.doc_id < 300) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert quality_classifier.quality_scores(empty, labels).count() == 0


def test_isotonic_is_monotone():
    xs, ys = quality_classifier.isotonic(np.arange(6.0), np.array([0, 3, 1, 2, 9, 10]), np.full(6, 10))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()


def test_lexicon_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if False else (lambda prev: [cur := i] + [cur := min(prev[j] + 1, cur + 1, prev[j - 1] + (x != b[j - 1])) for j in range(1, len(b) + 1)])(row)
        return row[-1]

    terms = ["idiot", "worthless", "scum", "trash"]
    automaton, rng = toxicity.LexiconAutomaton([(t, False) for t in terms]), random.Random(4)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "t", "x"])
        w = "".join(w)
        near = [distance(w, t) for t in terms if distance(w, t) <= (2 if len(t) >= 9 else 1 if len(t) >= 5 else 0)]
        found = automaton.match(w)
        assert (found is None) == (not near) and (found is None or found[0] == min(near)), w
    stems = toxicity.LexiconAutomaton([("lowei", True)])
    assert stems.match("loweichen") == (0, 0) and stems.match("lowe") is None


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        words = [rng.choice("der die das und mit von haus baum see berg".split()) for _ in range(40)]
        if i % 4 == 0:
            words[5:5] = ["zorn" + rng.choice(["ig", "haft", "voll", "en", "es", "er"]) for _ in range(3)]
        rows.append((i, " ".join(words)))
    got = toxicity.toxicity_scores(spark.createDataFrame([*rows, (900, None)], "doc_id long, text string"), labels_for(spark, rows)).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id < 900)
    assert [r.predicted for r in got if r.doc_id == 900] == [0]


def test_toxicity_learns_stems_that_clean_texts_hold_once(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice("der die das und mit von haus baum see berg".split()) for _ in range(40 if toxic else 200)]
        words[5:5] = ["zorn" + rng.choice(["ig", "haft", "voll", "en", "es", "er"]) for _ in range(4 if toxic else i % 2)]
        rows.append((i, " ".join(words)))
    got = toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels_for(spark, rows)).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got)


def test_quoted_hits_are_told_apart():
    automaton = toxicity.LexiconAutomaton([("idiot", False)])
    free, quoted = (toxicity.context_scores(t, automaton, {}) for t in ("you are an idiot", 'they wrote "what an idiot he is" and left'))
    assert free[0] > 0 and quoted[0] == 0 and quoted[2] > 0


def test_stems_allow_edits():
    automaton = toxicity.LexiconAutomaton([("lowei", True), ("abscheul", True), ("hass", True)])
    assert [automaton.match(w) for w in ("lowexchen", "lwwei", "loeichen", "abxcheuliche", "bscheuliche", "haxsen", "loxxi")] == [(1, 0), (1, 0), (1, 0), (1, 1), (1, 1), None, None]
    both = toxicity.LexiconAutomaton([("idiot", False), ("idiot", True)])
    assert both.match("idiots") == (0, 1) and both.match("idiot")[0] == 0


def test_quotation_reaches_over_the_whole_text():
    far = " ".join(["so"] * 40)
    got = toxicity.context_scores(f'they wrote "{far} idiot {far}" and left', toxicity.LexiconAutomaton([("idiot", False)]), {})
    assert got[0] == 0 and got[2] > 0


def test_weak_rules_counts_and_verdict(spark, docs, rows):
    got = {r.doc_id: r for r in weak_rules.judged_documents(docs).collect()}
    for i, t in rows:
        words = (t or "").split()
        grams = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        covered = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert got[i].base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (got[i].base_failed and got[i].kept)


def test_rules_em_separates_two_kinds():
    patterns = np.array([[1] * 7 + [2], [0] + [1] * 7])
    post, _, _ = weak_rules.estimate(patterns, np.array([90.0, 10.0]))
    assert post[0] > 0.9 and post[1] < 0.5


def test_lm_base_and_probability(docs, rows, empty):
    import math
    from collections import Counter

    train, tokens = Counter(), {i: lm_mixing.lm_tokens((t or "").encode()) for i, t in rows}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(w)
    n, v = sum(train.values()), len(train)
    for r in lm_mixing.lm_scores(docs).collect():
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert lm_mixing.lm_scores(empty).count() == 0


def test_lm_token_counts_are_those_of_the_scores_without_scoring(docs, empty, monkeypatch):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    want = sorted(map(tuple, lm_mixing.lm_scores(docs).select(*columns).collect()))
    for step in ("spell_table", "_scores"):
        monkeypatch.setattr(lm_mixing, step, None)
    got = lm_mixing.lm_token_counts(docs)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == want
    assert lm_mixing.lm_token_counts(empty).count() == 0


def plain_model(texts, train, i):
    """Counts of sequences elsewhere and before, by dictionaries; then the decisions of each token as (kind, context total, known or not, share)."""
    from collections import Counter

    start = b""
    tokens = [lm_mixing.lm_tokens(t) for t in texts]
    padded = lambda w, n: [tuple(([start] * (n - 1) + w)[k : k + n]) for k in range(len(w))]
    counts = {n: Counter(g for j, w in enumerate(tokens) if train[j] and j != i for g in padded(w, n)) for n in (1, 2, 3)}
    documents = sum(t for j, t in enumerate(train) if j != i)
    contexts = {n: Counter() for n in (2, 3)}
    for n in (2, 3):
        for g, c in counts[n].items():
            contexts[n][g[:-1]] += c
    total, out = sum(counts[1].values()), []
    assert contexts[2][(start,)] == documents
    for k in range(len(tokens[i])):
        steps = []
        for n in (3, 2, 1):
            g = padded(tokens[i], n)[k]
            seen = contexts[n][g[:-1]] if n > 1 else total
            if seen:
                steps.append((n, seen, counts[n][g] > 0, counts[n][g] / seen))
                if counts[n][g]:
                    break
        out.append(steps)
        for n in (1, 2, 3):
            g = padded(tokens[i], n)[k]
            counts[n][g] += 1
            if n > 1:
                contexts[n][g[:-1]] += 1
        total += 1
    return out


def plain_mixing(bits):
    """The mixer bit by bit: bits are (inputs, gate, bit) of one stretch."""
    import math

    weights = {g: [float(w) for w in lm_mixing.WEIGHTS[g]] for g in range(lm_mixing.GATES)}
    cells, out = {}, 0.0
    for x, g, y in bits:
        dot = sum(a * b for a, b in zip(x, weights[g]))
        p = 1 / (1 + math.exp(-dot))
        weights[g] = [w + lm_mixing.RATE * (y - p) * v for w, v in zip(weights[g], x)]
        cell = min(max(int((dot + 8) * lm_mixing.BUCKETS / 16), 0), lm_mixing.BUCKETS - 1)
        r = cells.setdefault((g, cell), 1 / (1 + math.exp(-((cell + 0.5) / lm_mixing.BUCKETS * 16 - 8))))
        cells[g, cell] += lm_mixing.MAP_RATE * (y - r)
        q = 0.75 * p + 0.25 * r
        out += math.log10(q if y else 1 - q)
    return out


def test_lm_mixing_equals_a_mixer_that_goes_bit_by_bit():
    rng = np.random.default_rng(8)
    lanes, parent = np.array([40, 7, 1, 90, 30]), np.array([-1, -1, -1, -1, 3])
    n = lanes.sum()
    x, bit, gate = rng.normal(size=(n, 4)).astype(np.float32), rng.integers(0, 2, n).astype(np.uint8), rng.integers(0, 5, n)
    got = np.add.reduceat(lm_mixing.mixed(x, bit, gate, lanes, parent), np.cumsum(lanes) - lanes)
    one = lambda a, b: plain_mixing(list(zip(x[a:b].tolist(), gate[a:b].tolist(), bit[a:b].tolist())))
    want = [one(0, 40), one(40, 47), one(47, 48), one(48, 138)]
    assert np.allclose(got[:4], want, rtol=1e-4) and np.isclose(got[4], one(48, 168) - one(48, 138), rtol=1e-3)


def test_lm_counts_equal_plain_ones(rows):
    """Every token's context totals and shares, taken back out of the operator, are those of a plain count elsewhere and before."""
    from factloom.llm.common import WordHashes

    texts = [(t or "").encode() for _, t in rows][:40]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows][:40]
    block = lm_mixing.Block(texts, WordHashes())
    mask, counts = np.array(train)[block.own], []
    for h in block.hashes:
        before, own = lm_mixing._own_counts(h, block.own)
        _, where = np.unique(h, return_inverse=True)
        counts.append(np.bincount(where, mask).astype(np.int64)[where] - np.where(mask, own, 0) + before)
    ends = np.cumsum(block.sizes)
    for i in (0, 1, 5, 11, 30):
        plain = plain_model(texts, train, i)
        for k, steps in enumerate(plain):
            at = ends[i] - block.sizes[i] + k
            for n, seen, known, share in steps:
                assert (counts[n - 1][at] > 0) == known
                if n > 1 and k:
                    assert counts[n - 2][at - 1] == seen
                assert counts[n - 1][at] / seen == share


def test_lm_probabilities_of_all_next_tokens_sum_to_one_at_most():
    """One document, each possible last word in turn (known ones, and unknown ones of one letter or none)."""
    from factloom.llm.common import WordHashes

    head, vocabulary = "a b a c a b a d b a", [b"a", b"b", b"c", b"d"]
    spell = np.random.default_rng(1).normal(size=lm_mixing.SPELL_SLOTS).astype(np.float32)
    total = 0.0
    for w in [*vocabulary, *(bytes([c]) for c in range(256) if bytes([c]).split() and bytes([c]).lower() == bytes([c]) and bytes([c]) not in vocabulary)]:
        text = head.encode() + b" " + w
        block = lm_mixing.Block([text], WordHashes())
        counts = [lm_mixing._own_counts(h, block.own)[0] for h in block.hashes]
        logs = lm_mixing._scored_tokens(block, counts, np.zeros(len(block.own), np.int64), block.place.copy(), spell)
        total += 10 ** logs[-2]
    assert 0 < total <= 1


def test_lm_scores_tell_copies_apart(spark, rows):
    docs = spark.createDataFrame([*rows, (2000, rows[7][1]), (2001, "z" * 200_000 + " again" * 60_000)], "doc_id long, text string")
    one = {r.doc_id: r.score for r in lm_mixing.lm_scores(docs.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in lm_mixing.lm_scores(docs.repartition(7)).collect()}
    # Counts are those of all blocks; only the spelling of unknown words is gathered block by block.
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) <= 0.1 * abs(one[k]) for k in one), max((abs(one[k] - many[k]) / abs(one[k]), k) for k in one)
    alone = {r.doc_id: r.score for r in lm_mixing.lm_scores(docs.where("doc_id <> 2000")).collect()}
    assert one[7] > alone[7] * 0.6 > 2 * alone[7]


def test_lm_packing_keeps_counts_and_keys():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 9, 1000):
        counts = rng.choice([0, 1, 1, 2, 5, 254, 255, 256, 10**12], n).astype(np.int64)
        keys = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        for parts in (48, 800_000):
            for order in (1, 2, 3):
                got, c = lm_mixing._unpacked(order, lm_mixing._packed(order, keys, counts, parts), parts)
                lost = np.uint64(8 * (8 - lm_mixing._width(order, parts)))
                assert c.tolist() == counts.tolist() and got.tolist() == (keys >> lost << lost).tolist()
        assert lm_mixing._width(1, 48) == lm_mixing._width(2, 800_000) == 8 and lm_mixing._width(3, 48) == 6


def test_letters_of_many_blocks_are_counted_at_once(monkeypatch):
    """A count passes over all slots, however few words it has; blocks used to take one each."""
    import pyarrow as pa

    from factloom.llm import lm_mixing
    from factloom.llm.common import split_of

    counted, real = [], lm_mixing.letter_counts
    monkeypatch.setattr(lm_mixing, "letter_counts", lambda words: counted.append(sorted(words)) or real(words))
    ids = [i for i in range(40) if split_of([i], 5)[0] != 1][:3]
    columns = [pa.array([0, 1, 2], pa.int64()), pa.array([[i] for i in ids], pa.list_(pa.int64())), pa.array([[b"one two two"], [b"one three"], [b"four"]], pa.list_(pa.binary()))]
    rows = list(lm_mixing._sent(4, 5, 1)(iter([pa.RecordBatch.from_arrays(columns, names=["block", "ids", "texts"])])))
    # Words that stand once in their block, ends too.
    assert counted == [sorted([b"one", b"\n", b"one", b"three", b"\n", b"four", b"\n"])]
    kinds = [k for r in rows for k in r.column(1).to_pylist()]
    assert kinds.count(lm_mixing.SPELL) == lm_mixing.CHUNKS


def through_the_corpus(blocks, parts=12):
    """For each block of (ids, texts) what the operator has for its tokens: block, train, counts, own counts, what the corpus leaves each way by; and the corpus' tokens."""
    import pyarrow as pa

    from factloom.llm.common import WordHashes, split_of

    columns = [pa.array(range(len(blocks)), pa.int64()), pa.array([b[0] for b in blocks], pa.list_(pa.int64())), pa.array([b[1] for b in blocks], pa.list_(pa.binary()))]
    sent = pa.Table.from_batches(list(lm_mixing._sent(parts, 5, 1)(iter([pa.RecordBatch.from_arrays(columns, names=["block", "ids", "texts"])]))))
    rows = pa.Table.from_batches(list(lm_mixing._answered(parts)(iter(sent.sort_by([("part", "ascending"), ("kind", "ascending")]).to_batches())))).to_pylist()
    tops, out = np.zeros(lm_mixing.word_parts(parts), np.int64), []
    for r in rows:
        if r["kind"] == lm_mixing.TOTAL:
            tops[r["part"]] = np.frombuffer(r["blob"], np.int64)[0]
    for number, (ids, texts) in enumerate(blocks):
        block = lm_mixing.Block(texts, WordHashes())
        train, counts, own, elsewhere = (split_of(ids, 5) != 1)[block.own], [], [], []
        for order, h in enumerate(block.hashes, 1):
            everywhere, leave = lm_mixing._everywhere(h, order, [r for r in rows if r["block"] == number and r["kind"] == order], tops)
            own.append(lm_mixing._own_counts(h, block.own))
            elsewhere.append(leave)
            counts.append(everywhere - np.where(train, own[-1][1], 0) + own[-1][0])
        out.append((block, train, counts, own, elsewhere))
    return out, int(tops.sum())


def test_lm_known_tokens_are_told_bit_by_bit_by_counts_of_the_corpus(rows):
    """A known token used to be told by its share of its context's count, without a bit that is mixed. Every bit's counts are those of a plain count over the continuations elsewhere and before."""
    from collections import Counter
    from math import log

    ids, texts = [i for i, _ in rows][:40], [(t or "").encode()[:1500] for _, t in rows][:40]
    texts[3] = texts[4] + b" and " + texts[4]
    blocks = [(ids[:25], texts[:25]), (ids[25:], texts[25:])]
    (block, train, counts, own, elsewhere), *_ = through_the_corpus(blocks)[0]
    known, open_ = [None] * 3, np.ones(len(block.own), bool)
    for k in (2, 1, 0):
        known[k] = open_ & (counts[k] > 0)
        open_ &= ~known[k]
    token, behind, x, bit, gate = lm_mixing._told(block, counts, own, known, train, elsewhere)
    got = {}
    for t, b, row, y in sorted(zip(token.tolist(), behind.tolist(), x.tolist(), bit.tolist()), key=lambda r: (r[0], -r[1])):
        got.setdefault(t, []).append((*row, y))
    code = dict(zip(block.words, (int(h) for h in block.hashes[0])))
    memo = lm_mixing.WordHashes()
    code |= {w: int(h) for t in texts for b in [lm_mixing.Block([t], memo)] for w, h in zip(b.words, b.hashes[0])}
    padded = [[b"", b"", *lm_mixing.lm_tokens(t)] for t in texts]
    teaches, ends, bits = [zlib.crc32(str(i).encode()) % 5 != 1 for i in ids], np.cumsum(block.sizes), 0
    assert not all(teaches[:25])
    for i in (0, 3, 4, 7, 11, 20, teaches.index(False)):
        seen = [{}, {}, {}]

        def add(w, k, seen=seen):
            for n in (1, 2, 3):
                seen[n - 1].setdefault(tuple(w[k - n + 1 : k]), Counter())[w[k]] += 1

        for j, w in enumerate(padded):
            for k in range(2, len(w)):
                if teaches[j] and j != i:
                    add(w, k)
        w, first = padded[i], ends[i] - block.sizes[i]
        for k in range(2, len(w)):
            ways = [seen[n - 1].get(tuple(w[k - n + 1 : k]), Counter()) for n in (1, 2, 3)]
            n = next((n for n in (3, 2, 1) if ways[n - 1][w[k]]), 0)
            want = []
            for b in range((40 if n == 1 else 24) if n else 0):
                here, there = [0] * 3, [0] * 3
                for m in range(n):
                    for u, c in ways[m].items():
                        if c and code[u] >> (64 - b) == code[w[k]] >> (64 - b):
                            same = code[u] >> (63 - b) == code[w[k]] >> (63 - b)
                            here[m], there[m] = here[m] + c * same, there[m] + c * (not same)
                if there[n - 1]:
                    one = code[w[k]] >> (63 - b) & 1
                    want.append([(1 if one else -1) * max(-8, min(8, log((here[m] + 0.02) / (there[m] + 0.02)))) for m in range(n - 1, -1, -1)][: 3] + [one])
            told = got.get(first + k - 2, [])
            assert [r[-1] for r in told] == [r[-1] for r in want]
            # The third input of the first two orders may be that of the document.
            assert all(np.allclose(a[:n], b[:n], atol=1e-5) for a, b in zip(told, want)), (i, k, n, told, want)
            bits += len(want)
            add(w, k)
    assert bits > 1500


def test_lm_probabilities_sum_to_one_at_most_behind_a_corpus():
    """Held-out documents of one block that differ in their last word alone, behind a corpus that knows some of them."""
    corpus = [b"a b c", b"a b d", b"a c a b c", b"b c d e f g", b"a b e", b"c c c", b"a b c b a", b"f b a b"]
    words = [*b"a b c d e f g".split(), b"", *(bytes([c]) for c in range(256) if bytes([c]).split() and bytes([c]).lower() == bytes([c]) and bytes([c]) not in b"abcdefg")]
    teach, held = ([i for i in range(9999) if (zlib.crc32(str(i).encode()) % 5 == 1) == h] for h in (False, True))
    for head in (b"b a b", b"b z"):
        texts = [head + b" " + w for w in words]
        blocks, tokens = through_the_corpus([(teach[: len(corpus)], corpus), (held[: len(texts)], texts)])
        block, train, counts, own, elsewhere = blocks[1]
        assert not train.any()
        spell = lm_mixing.spell_table(np.zeros(lm_mixing.SPELL_SLOTS, np.int64))
        scores = lm_mixing._scored_tokens(block, counts, np.full(len(block.own), len(corpus)), tokens + block.place, spell, train, own, elsewhere)
        total = (10.0 ** scores[block.place == len(head.split())]).sum()
        assert 0.3 < total <= 1, (head, total)


def test_lm_bits_that_are_held_at_once_are_bounded(docs, monkeypatch):
    """All bits of a block used to be held at once."""
    ids, texts = zip(*[(r.doc_id, (r.text or "").encode()[:3000]) for r in docs.limit(40).collect()], (7001, b""), (7002, b"x"), (7003, b""))
    (block, train, counts, own, elsewhere), *_ = through_the_corpus([(list(ids), list(texts)), (list(range(20)), list(texts[:20]))])[0]
    spell = lm_mixing.spell_table(np.zeros(lm_mixing.SPELL_SLOTS, np.int64))
    given = (block, counts, np.full(len(block.own), 30), np.full(len(block.own), 9000), spell, train, own, elsewhere)
    whole, sizes, real = lm_mixing._scored_tokens(*given), [], lm_mixing._scored_tokens
    monkeypatch.setattr(lm_mixing, "SCORED_TOKENS", 600)
    monkeypatch.setattr(lm_mixing, "_scored_tokens", lambda b, *a: sizes.append(len(b.words)) or real(b, *a))
    assert np.allclose(lm_mixing.scored(*given), whole, rtol=1e-5) and len(sizes) > 3 and max(sizes) <= max(600, block.sizes.max()) and sum(sizes) == len(whole)
