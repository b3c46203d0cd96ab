"""The pipeline on a small table, stage by stage."""

import hashlib

import base64
import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from rowloom.llm import bpe


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghijklm"), rng.integers(3, 8))) for _ in range(800)]
    text = lambda n=60: " ".join(rng.choice(vocab, n))
    item = text(24)
    clean = {i: text() + "." for i in range(120)}
    docs = dict(clean)
    toxic = {200 + i: text(30) + f". you {w} zurkwort fool. " + text(20) for i, w in enumerate(rng.choice(vocab, 60))}
    docs |= toxic
    docs |= {400: "few words", 401: "same five words again now " * 30, 402: None, 403: ""}
    docs |= {500: docs[3], 501: docs[3] + " tail", 502: "x " + docs[4]}
    docs |= {600: text(20) + " " + item + " " + text(20)}
    spark.createDataFrame([(k, t, "en", f"s{k % 5}", len(t or "")) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in docs if k < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(clean)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, r in got.items():
        ids = ref.encode_ordinary(docs[k])
        assert r.n_tokens == len(ids) and bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.decoded_sha256 == hashlib.sha256(docs[k].encode()).hexdigest()


def test_stages_have_columns_of_documents(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "neardup", "decontaminate", "bpe"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score string")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, empty, str(tmp_path)).columns == empty.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
