import numpy as np
import pandas as pd

from rowloom.llm import toxicity
from rowloom.llm.textnp import Bytes


def made(n=400, seed=3):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [list(rng.choice(vocab, rng.integers(4, 9))) for _ in range(rng.integers(1, 9))]
        bad = i % 4 == 0
        if bad:
            words[rng.integers(len(words))].insert(2, "zwurst" + rng.choice(["", "en", "ig"]))
        docs.append((i, " ".join(" ".join(s) + "." for s in words), "x"))
        labels.append((i, None if i % 50 == 3 else 1, int(bad)))
    return docs, labels


def test_sentences_and_words_match_plain_code():
    texts = ["One two. Three!", "", "é Ab\nCD", "..."]
    b = Bytes(texts)
    words = [bytes(b.low[i:j]).decode() for i, j in zip(b.starts, b.ends)]
    assert words == ["one", "two", "three", "é", "ab", "cd"]
    assert toxicity._sentences(b).tolist() == [2, 0, 2, 0]
    assert len(set(Bytes(["abc ABC", "abc"]).words().tolist())) == 1
    at, _ = b.grams(3)
    assert [bytes(b.low[i : i + 3]).decode() for i in at] == ["one", "two", "thr", "hre", "ree"]


def test_learns_and_locates(spark):
    docs, labels = made()
    df = spark.createDataFrame(docs + [(9001, None, "x"), (9002, "", "x")], "doc_id long, text string, score string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity._allowed())
    got = toxicity.scored(df.select("doc_id", "text"), model).toPandas().set_index("doc_id")
    truth = pd.Series({i: y for i, _, y in labels})
    assert (got.predicted.loc[truth.index] == truth).mean() > 0.97
    bad = got.loc[[i for i in truth.index if truth[i] and got.predicted[i]]]
    assert all(any("zwurst" in s for s in found) for found in bad.offending if len(found)) and got.score.loc[9001] == got.score.loc[9002] == 0


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(df, none, toxicity._allowed())
    assert {r.score for r in toxicity.scored(df, model).collect()} == {0.5}
    one = toxicity.train(df, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"), toxicity._allowed())
    assert {r.score for r in toxicity.scored(df, one).collect()} == {0.0}
    assert toxicity.scored(df.limit(0), model).count() == 0


def test_stage_keeps_columns(spark, tmp_path):
    docs, labels = made()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame([(*d, 1.5) for d in docs], "doc_id long, text string, predicted string, score double")
    got = toxicity.stage(spark, df, str(tmp_path))
    assert got.columns == df.columns and 250 < got.count() < 330


def test_fit_within_a_bound_of_features_and_repeated_rows(spark):
    docs, labels = made()
    df = spark.createDataFrame(docs * 3, "doc_id long, text string, score string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole = toxicity.train(df, labels, toxicity._allowed())
    once = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string, score string"), labels, toxicity._allowed())
    assert np.allclose(whole["weights"], once["weights"], atol=1e-5) and whole["prior"] == once["prior"]
    few = toxicity.train(df, labels, toxicity._allowed(), most=60)
    assert few["learned"] and 0 < (few["weights"] > 0).sum() <= (whole["weights"] > 0).sum()


def test_noisy_or_against_plain_code(spark):
    docs, labels = made(60)
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity._allowed())
    for _, text, _ in docs[:20]:
        none = 1.0
        for part in text.replace("!", ".").split("."):
            if part.strip():
                z = model["bias"] + sum(float(model["weights"][k]) for k in toxicity.features(Bytes([part]))[1])
                none *= 1 - 1 / (1 + np.exp(-z))
        assert abs(toxicity.score_whole([text], model)[0][0] - (1 - none)) < 1e-4


def test_long_text_finds_its_sentence(spark, monkeypatch):
    docs, labels = made()
    df = spark.createDataFrame(docs, "doc_id long, text string, x string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity._allowed())
    bad = next(t for i, t, _ in docs if "zwurst" in t)
    monkeypatch.setattr(toxicity, "LONG", 1000)
    score, found = toxicity.score_whole(["plain words here. " * 3000 + bad + " plain words here." * 3000], model)
    assert score[0] >= 0.5 and len(found[0]) == 1 and "zwurst" in found[0][0]
