import base64
import hashlib

import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from rowloom.llm import bpe

TEXTS = [
    "", " ", "a", "hello world", "it's  we'll\n\n  x\t", "naïve café 日本語 😀👍🏽", "<|endoftext|>", "1234567890" * 3,
    "aaaa" * 300, "ab" * 900, "=" * 5000, "\x1c\x1d\x85   x", "é" * 50, "\0\x01", "The the THE " * 200, "Z" * 257 + "abcab" * 80,
]


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    return bpe.Bpe(bpe.vocabulary(), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_tiktoken(both):
    own, ref = both
    for text, ids in zip(TEXTS, own.encode(TEXTS)):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text), text[:40]
        assert own.decode(ids) == text.encode()


def test_random_bytes_and_long_pieces(both):
    own, ref = both
    rng = np.random.default_rng(5)
    alphabets = ["ab", "aeiounrst", "абвгд", "éèçaou", "0123", "!?#*"]
    texts = ["".join(rng.choice(list(a), n)) for a in alphabets for n in (3, 17, 64, 255, 256, 300, 3000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text), text[:40]


def test_blocks_equal_whole(both, monkeypatch):
    own, ref = both
    text = "some words, 123 and more…\n\n" * 400
    monkeypatch.setattr(bpe, "BLOCK", 1000)
    assert np.frombuffer(next(own.encode([text])), "<u4").tolist() == ref.encode_ordinary(text)


def test_query_rows(spark, tmp_path):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "é" * 700, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, bpe.op1_bpe(spark, str(tmp_path)).collect()), key=str)
    assert len(got) == 5
    by = {r[0]: r for r in got}
    assert by[2][1] == 0 and by[2][2] == by[2][3] == hashlib.sha256(b"").hexdigest()
    assert by[None][3] == hashlib.sha256(("é" * 700).encode()).hexdigest()
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_very_long_piece_takes_its_length(both):
    own, ref = both
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("etaoinshrdlu"), 200_000))
    began = time.time()
    ids = np.frombuffer(next(own.encode([text])), "<u4")
    assert time.time() - began < 20 and own.decode(ids.tobytes()) == text.encode()
    assert ids[:2000].tolist() == ref.encode_ordinary(text[:20_000])[:2000]


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2.0)], "doc_id long, text string, ids string, piece double")
    out = bpe.decode(bpe.encode(df))
    assert set(out.columns) == {"doc_id", "text", "piece", "ids", "decoded"} and bytes(out.first().decoded) == b"a b"
