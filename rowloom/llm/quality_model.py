"""Quality classifier (3): a regularised quadratic discriminant over transformed statistics of a text.

Each class has a mean and a covariance, shrunk towards its own diagonal, the pooled covariance and a
small ridge. A score is the sigmoid of the difference of the two log densities plus the log prior odds,
per statistic; the densities are Mahalanobis distances through Cholesky factors that are made once and
sent with the model. The moments come from a sample of SAMPLE labelled texts: every partition sums its
own rows per class, and the sums of sums, whose number depends on the number of statistics alone, go to
the driver.

Cases: null text counts as empty and is scored like it; repeated rows each give a row; with no label,
or too few of a class, the score is the share of class 1 (0.5 without labels); an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import remainder, table, text_or_empty
from rowloom.llm.training import labelled

SAMPLE = 20_000
#: Weights of the class's own diagonal and of the pooled covariance, and the ridge.
TO_DIAGONAL, TO_POOLED, RIDGE = 0.1, 0.02, 1e-3
LEAST = 5

NAMES = ("words", "distinct", "symbols", "capitals", "exclaims", "word_length", "dup_lines", "digits", "top_word", "stops", "stutter", "letters", "lines", "long_words", "bars", "alpha_words")
_SYMBOLS = "#*$%&|<>@^~=_{}[]\\/+"
_STOP = re.compile(r"[.!?]+(?=\s|$)")


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text: shares on a logarithmic scale, so that the many texts with
    none and the few with a lot both lie within reach of a Gaussian."""
    words = text.split()
    n, chars = len(words), len(text)
    share = lambda k, of, scale=100.0: float(np.log1p(scale * k / of)) if of else 0.0
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    alpha = sum(map(str.isalpha, words))
    return [
        float(np.log1p(n)),
        float(np.log((len(seen) + 1) / (n + 1))),
        share(sum(map(text.count, _SYMBOLS)), n),
        share(sum(w.isupper() and len(w) > 1 for w in words), n),
        share(text.count("!"), n),
        (chars - n) / n if n else 0.0,
        share(len(lines) - len(set(lines)), len(lines)),
        share(sum(map(text.count, "0123456789")), chars, 1000.0),
        float(np.log((max(seen.values(), default=0) + 1) / (n + 2))),
        share(len(_STOP.findall(text)), n),
        share(sum(a == b for a, b in zip(words, words[1:])), n),
        share(n - alpha, n),
        share(len(lines), n),
        share(sum(len(w) > 20 for w in words), n),
        share(text.count("|"), n),
        float(np.log((alpha + 1) / (n + 2))),
    ]


def matrix(texts: list) -> np.ndarray:
    return np.array([statistics("" if t is None else t) for t in texts], float).reshape(-1, len(NAMES))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = len(NAMES) + 1
    sums = np.zeros((2, d, d))
    for pdf in batches:
        x, y = matrix(pdf["text"].tolist()), pdf["y"].to_numpy()
        x = np.hstack([np.ones((len(x), 1)), x])
        for k in (0, 1):
            sums[k] += x[y == k].T @ x[y == k]
    yield pd.DataFrame({"k": np.repeat([0, 1], d * d), "i": np.tile(np.arange(d * d), 2), "v": sums.ravel()})


def fit(sums: np.ndarray) -> dict:
    """sums[k]: for class k the sums of products of (1, statistics)."""
    n = sums[:, 0, 0]
    prior = float(n[1] / n.sum()) if n.sum() else 0.5
    if n.min() < LEAST:
        return {"prior": prior, "learned": False}
    means = sums[:, 0, 1:] / n[:, None]
    cov = [sums[k, 1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    model = {"prior": prior, "learned": True, "scale": scale, "classes": []}
    pooled = pooled / np.outer(scale, scale)
    for k in (0, 1):
        c = cov[k] / np.outer(scale, scale)
        own = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c))
        own = (1 - TO_POOLED) * own + TO_POOLED * pooled + RIDGE * np.eye(len(c))
        low = np.linalg.cholesky(own)
        # The inverse of the factor is cached: a distance is then one product.
        model["classes"].append({"mean": means[k] / scale, "whiten": np.linalg.inv(low), "log_det": 2 * float(np.log(np.diag(low)).sum()), "log_prior": float(np.log(n[k] / n.sum()))})
    return model


def posterior(x: np.ndarray, model: dict) -> np.ndarray:
    """The share of class 1, softened per statistic, for each row of statistics."""
    if not model["learned"]:
        return np.full(len(x), model["prior"])
    logs = []
    for c in model["classes"]:
        z = (x / model["scale"] - c["mean"]) @ c["whiten"].T
        logs.append(c["log_prior"] - 0.5 * (c["log_det"] + (z * z).sum(1)))
    return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / len(NAMES), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, allowed, sample: int = SAMPLE) -> dict:
    rows = labelled(docs, labels, "quality", allowed, sample).select("text", "y")
    # Each partition's sums are one row per cell and class, added up in the JVM.
    cells = rows.mapInPandas(_moments, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
    d = len(NAMES) + 1
    sums = np.zeros((2, d * d))
    sums[cells["k"], cells["i"]] = cells["v"]
    return fit(sums.reshape(2, d, d))


def scored(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = posterior(matrix(batch.column(text).to_pylist()), sent.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score), pa.array((score >= 0.5).astype("int32"))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, docs.select(*names).schema.add("score", "double").add("predicted", "integer"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    out = scored(docs.select("doc_id", text_or_empty("text").alias("text")), model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
