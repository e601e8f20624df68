import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from hopweave.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_equal_to_merging_by_rank(codec, reference):
    rng = random.Random(1)
    letters = "abcdeeeettaoinsr éèüß' \n\t 0123!?.漢字\U0001f600"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text
    for _ in range(4000):
        data = bytes(rng.choice(b"aeinrst thio") if rng.random() < 0.8 else rng.randrange(256) for _ in range(rng.randrange(1, 30)))
        assert codec.encode_match(data) == reference._encode_single_piece(data)


def test_long_matches_and_full_stores(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_MATCHES", 3)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 5)
    for text in ("ab" * 20000, "a" * 30000, "the cat sat on the mat " * 50):
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_tables(spark, documents, empty, sample, reference):
    out = bpe.token_digests(documents, RANKS, public_tokenizers.PATTERN, ["doc_id", "score"])
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
    expected = []
    for i, t in sample:
        ids = reference.encode_ordinary(t or "")
        expected.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected)
    assert bpe.token_digests(empty, RANKS, public_tokenizers.PATTERN, ["doc_id"]).count() == 0
    back = bpe.decode(bpe.encode(documents, RANKS, public_tokenizers.PATTERN, ["doc_id"]), RANKS)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back.collect()) == sorted((i or -1, t or "") for i, t in sample)
