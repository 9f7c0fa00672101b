import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brambling.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aAbBzZéÉßẞİIıΣσςΑΒ 0123٣½²'sStTmMdDllLLvere\n\t\x0b\x0c\r\x1c\x1d\x1f\x85\xa0 ​　̸́!?<|>|startoftext|><|endoftext|>😀中文字हिन्दीﬁ\x00"


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    return made + ["", " ", "<|startoftext|>Hello<|endoftext|> World", "a" * 3000, "é" * 2000 + " x", "x<|endoftext|>́y", "ab'" * 1000, "don't 'Sun I'LL"]


def test_like_the_library():
    mine, theirs = bpe.load(PATH), Tokenizer.from_file(PATH)
    for text, want in zip(texts(), theirs.encode_batch(texts(), add_special_tokens=False)):
        ids = mine.encode(text).tolist()
        assert ids == want.ids, text
        assert " ".join(map(bpe.spelled(PATH).__getitem__, ids)) == theirs.decode(want.ids, skip_special_tokens=False)


def test_scan_and_heap_agree():
    mine = bpe.load(PATH)
    rng = random.Random(2)
    for _ in range(300):
        parts = [mine.inner[rng.choice(b"abcdeinthrs")] for _ in range(rng.randint(1, 60))]
        assert mine._scan(list(parts)) == mine._heap(list(parts))
    for n in (bpe.SCAN_LIMIT - 1, bpe.SCAN_LIMIT, bpe.SCAN_LIMIT + 1, 1_000):
        for letters in (b"a", b"ab", b"abcdeinthrs"):
            parts = [mine.inner[rng.choice(letters)] for _ in range(n)]
            assert mine._scan(list(parts)) == mine._heap(list(parts))


def test_query_like_the_library(spark):
    """Every row of the query against the tokenizers library."""
    from brambling.llm import queries

    folder = "/root/testdata/sf0.01"
    theirs = Tokenizer.from_file(PATH)
    theirs.no_padding()
    theirs.no_truncation()
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, e in zip(rows, theirs.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r.doc_id] = (len(e.ids), digest(" ".join(map(str, e.ids))), digest(theirs.decode(e.ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, folder).collect()} == want


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    m = bpe.Memory(str.upper)
    assert [m[c] for c in "abcabcdefa"] == list("ABCABCDEFA")
    assert len(m) <= 3 and len(m.old) <= 3


def test_frames(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "the cat", 7), (3, "the cat", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.decode_ids(bpe.encode_documents(docs, PATH), PATH).collect()
    assert sorted((r.doc_id, len(r.ids), r.decoded) for r in out) == [(1, 0, ""), (2, 0, ""), (3, 2, "the</w> cat</w>"), (3, 2, "the</w> cat</w>")]
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("word", ["a", "lowest", "x" * 100])
def test_round_trip_of_bytes(word):
    mine = bpe.load(PATH)
    assert "".join(bpe.spelled(PATH)[i] for i in mine.encode(word)).removesuffix("</w>") == word
