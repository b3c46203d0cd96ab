"""Quality and language models: held-out accuracy on made texts, and the odd cases."""

from collections import Counter

import numpy as np

from rowloom.llm import langid, quality_model
from rowloom.llm.common import remainder


def test_quality_separates(spark):
    rng = np.random.default_rng(2)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        ws = list(rng.choice(vocab, rng.integers(30, 200)))
        bad = i % 3 == 0
        if bad:
            ws = [w.upper() + "!!" for w in ws] if i % 2 else [w + "$$$" for w in ws[:20]] * 4
        docs.append((i, " ".join(ws) + ".", "k"))
        labels.append((i, int(not bad), None))
    df = spark.createDataFrame(docs + [(9001, None, "k"), (9002, "", "k")], "doc_id long, text string, score string")
    model = quality_model.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), remainder("doc_id", 3) != 1)
    got = quality_model.scored(df.select("doc_id", "text"), model).toPandas().set_index("doc_id")
    truth = np.array([y for _, y, _ in labels])
    assert (got.predicted.loc[range(600)].to_numpy() == truth).mean() > 0.98
    assert got.score.between(0, 1).all() and got.score.loc[9001] == got.score.loc[9002]


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    model = quality_model.train(df, spark.createDataFrame([], "doc_id long, quality int"), remainder("doc_id", 3) != 1)
    assert {r.score for r in quality_model.scored(df, model).collect()} == {0.5}
    assert quality_model.scored(df.limit(0), model).count() == 0


def test_density_is_gaussian():
    rng = np.random.default_rng(0)
    d = len(quality_model.NAMES)
    x = [rng.normal(k, 1 + k, (500, d)) for k in (0, 1)]
    sums = np.stack([np.hstack([np.ones((500, 1)), a]).T @ np.hstack([np.ones((500, 1)), a]) for a in x])
    m = quality_model.fit(sums)
    p = quality_model.posterior(np.vstack(x), m)
    assert (p[:500] < 0.5).mean() > 0.95 and (p[500:] > 0.5).mean() > 0.9


def test_languages(spark):
    say = {"en": "the cat and the dog are in this house with a few of their friends ", "de": "der Hund und die Katze sind nicht in dem großen Haus und schlafen ", "ru": "собака и кошка живут в большом доме у реки ", "fr": "le chien et le chat sont dans la grande maison près de la rivière "}
    rows = [(i, say[k] * (1 + i % 3), k if i % 7 else None, "s") for i in range(80) for k in [list(say)[i % 4]]]
    df = spark.createDataFrame(rows + [(900, None, "en", "s"), (901, "123 !?", "en", "s"), (902, "", None, "s"), (903, say["de"] * 20_000, None, "s")], "doc_id long, text string, lang string, score string")
    model = langid.train(df, remainder("doc_id", 3) != 1)
    got = langid.predicted(df.select("doc_id", "text"), model).toPandas().set_index("doc_id")
    assert all(got.lang_pred[i] == list(say)[i % 4] for i in range(80)) and got.score.between(0, 1).all()
    assert all(got.lang_pred[i] == "und" for i in (900, 901, 902)) and got.lang_pred[903] == "de"
    empty = langid.train(df.limit(0), remainder("doc_id", 3) != 1)
    assert set(langid.predicted(df.select("doc_id", "text"), empty).toPandas().lang_pred) == {"und"}
    assert langid.predicted(df.select("doc_id", "text").limit(0), model).count() == 0


def test_blocks_count_like_one(monkeypatch):
    texts = ["Some words, and äöü more of them. ΟΔΟΣ straße İx " * 30, "a", "", "one two", "Zwei Wörter " * 9]
    plain = [Counter(b for n in langid.ORDERS for b in dict(langid.grams(np.concatenate([langid._SPACE, langid.codes(t), langid._SPACE])))[n].tolist()) for t in texts]
    for block in (1 << 19, 2000, 100, 7, 1):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = [Counter() for _ in texts]
        for first, doc, bucket, n in langid.bags(texts):
            for d, b, k in zip(doc, bucket, n):
                got[first + d][b] += k
        assert got == plain, block


def test_langid_query_ignores_other_columns(spark, tmp_path):
    rows = [(i, "the cat sat" if i % 2 else "der Hund schläft", "en" if i % 2 else "de", "und", 3) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in langid.op6_langid(spark, str(tmp_path)).collect()}
    assert len(got) == 60 and all(got[i].lang_pred == ("en" if i % 2 else "de") for i in got)
