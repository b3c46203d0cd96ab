"""Toxicity (7): multiple-instance learning. A text is a bag of sentences; sentence scores are combined by
noisy-or, P = 1 - prod(1 - p_s), and learned from the labels of whole texts.

A sentence's score is logistic in its hashed words and runs of GRAM bytes inside words. Training takes a
sample of SAMPLE labelled texts with MOST features in all: a first pass counts, per bucket, in how many toxic and
other texts it stands, and keeps the buckets that lean to the toxic side; a second pass brings the kept buckets of
each sentence to the driver as flat columns, where the weights are fitted by gradient steps on the noisy-or likelihood.
Scoring reads whole texts in batches; only the weights (BUCKETS floats) are broadcast.

Cases: null text counts as empty; an empty text has no sentence and so score 0; repeated rows each give a
row; where no label or only one class is given, the score is the share of class 1 (0.5 without labels); a
text of any length is cut in blocks of sentences; an empty table gives no rows; other columns are not read, and
those named as results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rowloom.llm.common import remainder, stored, table, text_or_empty
from rowloom.llm.textnp import AFTER_SENTENCES, LONG, Bytes, groups, pieces, slices, trim
from rowloom.llm.training import labelled

#: Labelled texts to learn from, and features of them that the driver holds (8 bytes each), at most.
SAMPLE, MOST = 20_000, 8_000_000
BUCKETS = 1 << 20
GRAM = 5
#: At least so many toxic texts have a kept bucket; so many buckets are kept at most.
MIN_TEXTS, KEPT = 5, 50_000
STEPS, RATE, RIDGE = 600, 0.5, 3e-6
TOXIC = 0.5


def features(b: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place in bytes, bucket) of each word and gram."""
    at, gram = b.grams(GRAM)
    n = np.uint64(BUCKETS - 1)
    return np.concatenate([b.starts, at]), np.concatenate([(b.words() & n), ((gram >> np.uint64(20)) & n)]).astype(np.int64)


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def _blocks(texts: list[str]) -> Iterator[tuple[int, int, list[list[str]]]]:
    """(first, end, blocks): groups of texts, as one block of several texts or as the pieces of one long text."""
    for first, part in groups(texts):
        yield first, first + len(part), [[p] for p in pieces(part[0], AFTER_SENTENCES)] if len(part) == 1 else [part]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, BUCKETS), np.int64)
    for batch in slices(batches):
        y = batch.column("y").to_numpy(zero_copy_only=False)
        for first, _, blocks in _blocks(_texts(batch, "text")):
            once = np.zeros(0, np.int64)
            for part in blocks:
                b = Bytes(part)
                at, bucket = features(b)
                once = np.unique(np.concatenate([once, (np.searchsorted(b.begins, at, "right") - 1) * BUCKETS + bucket]))
            doc, bucket = np.divmod(once, BUCKETS)
            for k in (0, 1):
                seen[k] += np.bincount(bucket[y[first + doc] == k], minlength=BUCKETS)
    has = np.flatnonzero(seen[1])
    yield pa.RecordBatch.from_pydict({"bucket": has, "neg": seen[0][has], "pos": seen[1][has]})
    trim()


def _bags(kept: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.full(BUCKETS, -1, np.int32)
        index[kept] = np.arange(len(kept))
        for batch in slices(batches):
            for first, end, blocks in _blocks(_texts(batch, "text")):
                n, s, f, before = np.zeros(end - first, np.int64), [[] for _ in range(first, end)], [[] for _ in range(first, end)], 0
                for part in blocks:
                    b = Bytes(part)
                    at, bucket = features(b)
                    sentence = b.sentences()
                    own = index[bucket]
                    at, own = at[own >= 0], own[own >= 0]
                    doc = np.searchsorted(b.begins, at, "right") - 1
                    n += _sentences(b)
                    order = np.argsort(doc, kind="stable")
                    cut = np.searchsorted(doc[order], np.arange(len(part) + 1))
                    for k, (i, j) in enumerate(zip(cut, cut[1:])):
                        s[k].append((before + sentence[at[order[i:j]]]).astype(np.int32))
                        f[k].append(own[order[i:j]])
                    before += int(sentence[-1]) + 1
                own = batch.slice(first, end - first)
                made = [own.column("y").cast(pa.int64()), pa.array(n), *(pa.array([np.concatenate(x).tobytes() for x in c], pa.binary()) for c in (s, f))]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), *made], names=["doc_id", "y", "n", "s", "f"])
        trim()

    return run


def _bounded(bags: DataFrame, most: int) -> DataFrame:
    """Those of the sampled texts that come first by the hash of their id, until they have `most` features in all."""
    own = bags.select("doc_id", F.length("f").alias("size"))
    if (own.agg(F.sum("size")).first()[0] or 0) <= 4 * most:
        return bags
    # As many rows as the sample has.
    before = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id"))
    return bags.join(F.broadcast(own.withColumn("before", before).where(F.col("before") <= 4 * most).select("doc_id")), "doc_id", "left_semi")


def _sentences(b: Bytes) -> np.ndarray:
    """How many sentences with a word each text has."""
    place = b.sentences()[b.starts]
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) > 0) | (np.diff(b.doc) > 0)
    return np.bincount(b.doc[new], minlength=len(b.begins))


def fit_bags(y: np.ndarray, n: np.ndarray, doc: np.ndarray, sentence_of: np.ndarray, feature: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias under noisy-or. sentence_of: for each feature its sentence, doc: for each sentence
    its text; the other sentences of a text (n in all) have the bias alone. Steps are AdaGrad's; weights
    don't go below 0, as the kept buckets lean to the toxic side."""
    w, b = np.zeros(n_features), -6.0
    gw, gb = np.full(n_features, 1e-8), 1e-8
    other = n - np.bincount(doc, minlength=len(y))
    for _ in range(STEPS):
        z = np.clip(b + np.bincount(sentence_of, w[feature], minlength=len(doc)), -30, 30)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        log_no = np.bincount(doc, np.log1p(-p), minlength=len(y)) + other * np.log1p(-p0)
        no = np.exp(np.minimum(log_no, -1e-12))
        pull = np.where(y > 0, -no / (1 - no), 1.0)  # d loss / d z_s = pull * p_s
        dz = pull[doc] * p
        dw = (np.bincount(feature, dz[sentence_of], minlength=n_features) + RIDGE * len(y) * w) / len(y)
        db = (dz.sum() + (pull * other * p0).sum()) / len(y)
        gw += dw**2
        gb += db**2
        w = np.maximum(w - RATE * dw / np.sqrt(gw), 0)
        b = min(b - RATE * db / np.sqrt(gb), -3.0)
    return w, b


def train(docs: DataFrame, labels: DataFrame, allowed, sample: int = SAMPLE, most: int = MOST) -> dict:
    """weights (BUCKETS floats), bias, and prior, which alone is used where there is nothing to learn."""
    rows = labelled(docs, labels, "toxic", allowed, sample)
    counts = rows.select("text", "y").mapInArrow(_count, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    n, pos = total["n"], total["pos"] or 0
    none = {"weights": np.zeros(BUCKETS, np.float32), "bias": 0.0, "prior": pos / n if n else 0.5, "learned": False}
    if not 0 < pos < n:
        return none
    lean = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (n - pos + 1))
    kept = counts.where((F.col("pos") >= min(MIN_TEXTS, pos)) & (lean > 1)).orderBy((lean * F.sqrt("pos")).desc(), "bucket").limit(KEPT).select("bucket").toPandas()["bucket"].to_numpy(np.int64)
    if not len(kept):
        return none
    kept = np.sort(kept)
    key = dict(rows.dtypes)["doc_id"]
    bags = stored(rows.mapInArrow(_bags(kept), f"doc_id {key}, y long, n long, s binary, f binary"), "bags")
    bags = _bounded(bags, most).select("y", "n", "s", "f").toArrow()
    # Flat columns: no Python object per feature, and none per sentence.
    size = np.array(pc.binary_length(bags["f"])) // 4
    place, feature = (np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in bags[c]] or [np.zeros(0, np.int32)]) for c in ("s", "f"))
    doc_of = np.repeat(np.arange(bags.num_rows), size)
    _, first, sentence_of = np.unique(doc_of * (1 << 32) + place, return_index=True, return_inverse=True)
    y, n_sentences = (bags[c].to_numpy() for c in ("y", "n"))
    w, b = fit_bags(y, n_sentences, doc_of[first], sentence_of, feature, len(kept))
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = w
    return {"weights": weights, "bias": float(b), "prior": pos / n, "learned": True}


def sentence_scores(b: Bytes, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, last byte, score) of each sentence that has a word."""
    at, bucket = features(b)
    place = b.sentences()
    w = model["weights"][bucket]
    hit = w != 0
    z = model["bias"] + np.bincount(place[at[hit]], w[hit], minlength=int(place[-1]) + 1)
    ends = np.flatnonzero(np.diff(place, append=place[-1] + 1))
    has = np.zeros(len(z), bool)
    has[place[b.starts]] = True
    own = np.flatnonzero(has)
    return np.searchsorted(b.begins, ends[own], "right") - 1, ends[own], 1 / (1 + np.exp(-np.clip(z[own], -30, 30)))


def score_text_group(texts: list[str], model: dict) -> tuple[np.ndarray, list[list[str]]]:
    """Noisy-or of each text and its offending sentences."""
    b = Bytes(texts)
    doc, end, p = sentence_scores(b, model)
    score = -np.expm1(np.bincount(doc, np.log1p(-p), minlength=len(texts)))
    found: list[list[str]] = [[] for _ in texts]
    place = b.sentences()
    for k in np.flatnonzero(p >= TOXIC):
        start = int(np.searchsorted(place, place[end[k]], "left"))
        found[doc[k]].append(bytes(b.raw[start : end[k] + 1]).strip(b"\0").decode(errors="replace").strip())
    return score, found


def score_whole(texts: list[str], model: dict) -> tuple[np.ndarray, list[list[str]]]:
    """score_text_group() for texts of any length: long ones go sentence by sentence in pieces, combined by the same noisy-or."""
    if all(len(t) <= LONG for t in texts):
        return score_text_group(texts, model)
    score, found = np.zeros(len(texts)), []
    for i, t in enumerate(texts):
        none, own = 1.0, []
        for piece in pieces(t, AFTER_SENTENCES):
            p, more = score_text_group([piece], model)
            none, own = none * (1 - p[0]), own + more[0]
        score[i] = 1 - none
        found.append(own)
    return score, found


def scored(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with score, predicted and offending (the sentences whose own score is TOXIC or more)."""
    names = [c for c in docs.columns if c not in ("score", "predicted", "offending")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches):
            texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
            score, found = np.full(len(texts), float(model["prior"])), [[] for _ in texts]
            if model["learned"]:
                for first, part in groups(texts):
                    score[first : first + len(part)], found[first : first + len(part)] = score_whole(part, model)
            made = [pa.array(score), pa.array((score >= TOXIC).astype("int32")), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "score", "predicted", "offending"])
        trim()

    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer").add("offending", T.ArrayType(T.StringType()))
    return docs.mapInArrow(run, schema)


def _allowed():
    return remainder("doc_id", 5) != 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), _allowed())
    out = scored(docs.select("doc_id", text_or_empty("text").alias("text")), model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"), F.array_join("offending", "\n").alias("offending"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are predicted toxic. Learns from the labelled documents that came so far."""
    model = train(docs, table(spark, sf_dir, "labels"), _allowed())
    own = docs.select(*[F.col(c).alias(f"_keep_{c}") for c in docs.columns])
    return scored(own, model, "_keep_text").where("predicted = 0").select(*[F.col(f"_keep_{c}").alias(c) for c in docs.columns])
