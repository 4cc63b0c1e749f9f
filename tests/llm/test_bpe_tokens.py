"""BPE encoding and decoding against the library, and on odd tables."""

import hashlib
import random
from array import array

import pyarrow as pa
import pytest

from factloom.llm import bpe_tokens
from factloom.llm.queries import word_bpe
from tests.llm.test_edges import LONG, SCHEMA, odd  # noqa: F401

ALPHABETS = [
    "ab", "abcdefghijklmnopqrstuvwxyz", "aA'sStTdDlLvVeErRmM ", "éßÄöΣσςİıŉǆ é ạ̊", "0123456789½²Ⅷ٣ x", "漢字かなकखि", "ᲉꟋ\U00010d50a ࢗ",
    "a!?.,;:<|>", "\t\n\r\x85\xa0​᠎\x1c\x1f ab!", "😀👍🏽!?a", "न्‍त à", "ͅΑ",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        chosen = rng.sample(ALPHABETS, rng.randint(1, 6))
        text = "".join(rng.choice(rng.choice(chosen)) for _ in range(rng.randint(0, 60)))
        yield text + rng.choice(["", "", "", "<|endoftext|>", " <|startoftext|><|endoftext|>x", "<|ENDOFTEXT|>", "<|endoftext|"])
    yield from ("", " \t\n", "a" * 5000, "the" * 900, "".join(rng.choice("abcdefg") for _ in range(3000)), "漢" * 1000, "in" * 700 + "ing" * 30, "hello " * 3000)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe())


def test_ids_and_decoded_texts_equal_the_library(library):
    model = bpe_tokens.WordBPE(word_bpe())
    texts = list(random_texts(4000, 1))
    packed = model.encode_batch(texts[:2000]) + model.encode_batch(texts[2000:])
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(array("I", p)) for p in packed] == expected
    decoded = model.decode_batch(pa.array(expected, pa.list_(pa.int32()))).to_pylist()
    assert decoded == [library.decode(e, skip_special_tokens=False) for e in expected]


def test_rounds_and_heap_agree_where_a_merge_makes_a_lower_pair(library, monkeypatch):
    """A token that two merges make: places of a word must then be merged one at a time."""
    model = bpe_tokens.WordBPE(word_bpe())
    texts = ["".join(random.Random(i).choice("abco") for _ in range(1 + i % 40)) for i in range(400)]
    by_rounds = model.merged([t.encode() for t in texts])
    model.at_once[:] = False
    assert model.merged([t.encode() for t in texts]) == by_rounds
    monkeypatch.setattr(bpe_tokens, "LONG", 0)
    assert model.merged([t.encode() for t in texts]) == by_rounds


def test_a_small_memo_changes_nothing(monkeypatch):
    texts = list(random_texts(300, 2))
    expected = bpe_tokens.WordBPE(word_bpe()).encode_batch(texts)
    monkeypatch.setattr(bpe_tokens, "MEMO_CHUNKS", 5)
    model = bpe_tokens.WordBPE(word_bpe())
    assert [model.encode_batch([t])[0] for t in texts] == expected


def test_documents(spark, odd, library):  # noqa: F811
    encoded = bpe_tokens.encode_documents(odd, word_bpe())
    rows = encoded.collect()
    given = odd.select("doc_id", "text").collect()
    expected = [e.ids for e in library.encode_batch([r.text or "" for r in given], add_special_tokens=False)]
    assert sorted((r.n_tokens, r.ids) for r in rows) == sorted((len(e), e) for e in expected)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    decoded = bpe_tokens.decode_documents(encoded, word_bpe())
    assert sorted(r.text for r in decoded.collect()) == sorted(library.decode(e, skip_special_tokens=False) for e in expected)
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_tokens.encoding_digests(odd, word_bpe()).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == {
        (r.doc_id, len(e), sha(array("I", e).tobytes()), sha(library.decode(e, skip_special_tokens=False).encode())) for r, e in zip(given, expected)
    }
    assert bpe_tokens.encoding_digests(odd.limit(0), word_bpe()).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe_tokens.decode_documents(nulls, word_bpe()).orderBy("doc_id").collect()] == ["", ""]
    assert len(LONG) > 2_000_000 and "ids string" in SCHEMA
