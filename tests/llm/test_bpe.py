"""Byte-level BPE against the tiktoken library over the same ranks."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from foliospark.llm import bpe

ARGS = (P.path("byte_bpe_50k.json"), P.PATTERN)
TEXTS = [
    None, "", " ", "a", "the end  of\n\n it's", "Ünï çödé — 漢字 🎉🎉", "<|endoftext|> x", "�́é",
    "1234567 don't   \t x\r\n", "x" * 3000, "na ïve z", "same", "same",
]


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_digests(spark, reference):
    got = {r.doc_id: r for r in bpe.roundtrip(frame(spark, TEXTS), "doc_id", "text", *ARGS).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = reference.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_ids_offsets_and_back(spark, reference):
    coded = bpe.encode(frame(spark, TEXTS), "doc_id", "text", *ARGS)
    for r in coded.collect():
        text = TEXTS[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(text)
        for b, c in zip(r.byte_starts, r.char_starts):
            whole = text.encode()[:b].decode(errors="ignore")
            assert c == len(whole)
    back = {r.doc_id: r.text for r in bpe.decode(coded, "doc_id", "ids", *ARGS).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    assert bpe.roundtrip(frame(spark, []), "doc_id", "text", *ARGS).count() == 0


def test_given_table(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.roundtrip(docs, "doc_id", "text", *ARGS).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
