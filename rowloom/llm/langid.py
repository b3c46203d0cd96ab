"""Language identification (6): multinomial naive Bayes over hashed character n-grams.

Counts come from a sample of about PER_LANG texts of each language (taken by a hash of the id, at a rate
set from the language's own count): partitions count their rows, the JVM adds the counts per language and
bucket, and the matrix of log probabilities (languages x BUCKETS floats) is broadcast; its size depends on
the number of languages only. Texts are scored in batches: their counts are the rows of a sparse matrix
(text, bucket, count), which is multiplied with the matrix of log probabilities.

Cases: null text, and text without a letter, give `und` with score 0; with no language to learn from all
rows give `und`; long texts are counted block by block, to the same counts; repeated rows each give a row; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import remainder, small, stored, table, text_or_empty
from rowloom.llm.textnp import groups, slices

PER_LANG = 4_000
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Characters that are counted at once; texts whose counts are held in full at once.
BLOCK, DENSE = 1 << 19, 16
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def codes(text: str) -> np.ndarray:
    """A text character by character, without case (a rule for single characters, so a text may be taken in blocks);
    what isn't a letter is a space."""
    code = np.frombuffer(text.casefold().encode("utf-32-le", "replace"), np.uint32)
    return np.where((code > 0x7F) | ((code >= 97) & (code <= 122)), code, np.uint32(32))


def grams(code: np.ndarray, fresh: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(length, bucket numbers) of the n-grams that end at `fresh` or later; the first of them starts at max(0, fresh - n + 1)."""
    for n in ORDERS:
        part = code[max(0, fresh - n + 1) :]
        size = max(0, len(part) - n + 1)
        h = np.full(size, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h = (h ^ part[j : j + size]) * _MULTIPLIERS[j]
            h ^= h >> np.uint32(15)
        yield n, (h & np.uint32(BUCKETS - 1)).astype(np.int64)


_SPACE = np.full(1, 32, np.uint32)


def _long_counts(text: str) -> np.ndarray:
    """Counts per bucket of one text, block by block; the last characters of a block are carried to the next."""
    counts, carry = np.zeros(BUCKETS, np.int64), _SPACE
    for k in range(0, len(text), BLOCK):
        fresh = len(carry) if k else 0
        code = np.concatenate([carry, codes(text[k : k + BLOCK]), _SPACE[: k + BLOCK >= len(text)]])
        for _, b in grams(code, fresh):
            counts += np.bincount(b, minlength=BUCKETS)
        carry = code[-(max(ORDERS) - 1) :]
    return counts


def bags(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse rows of counts, for DENSE texts or a long one at a time: (index of the first text, text, bucket, count). Each
    text stands between spaces; n-grams of two texts are left out."""
    for first, part in groups(texts, BLOCK):
        if len(part) == 1 and len(part[0]) > BLOCK:
            counts = _long_counts(part[0])
            has = np.flatnonzero(counts)
            yield first, np.zeros(len(has), np.int64), has, counts[has]
            continue
        for k in range(0, len(part), DENSE):
            own = [codes(t) for t in part[k : k + DENSE]]
            size = np.array([len(c) + 2 for c in own])
            code = np.concatenate([x for c in own for x in (_SPACE, c, _SPACE)])
            doc = np.repeat(np.arange(len(own)), size)
            counts = np.zeros(len(own) * BUCKETS, np.int64)
            for n, b in grams(code):
                same = doc[: len(b)] == doc[n - 1 :]
                counts += np.bincount(doc[: len(b)][same] * BUCKETS + b[same], minlength=len(counts))
            has = np.flatnonzero(counts)
            yield first + k, has // BUCKETS, has % BUCKETS, counts[has]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, doc, bucket, n in bags(batch.column("text").to_pylist()):
            lang = langs[first + doc]
            for one in set(lang):
                own = lang == one
                seen[one] = seen.get(one, 0) + np.bincount(bucket[own], n[own], BUCKETS)
    for lang, counts in seen.items():
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(has), pa.string()), pa.array(has.astype(np.int32)), pa.array(counts[has].astype(np.int64))], names=["lang", "bucket", "n"])


def train(docs: DataFrame, allowed: Column, per_lang: int = PER_LANG) -> dict:
    """Names of the languages, and log probabilities (BUCKETS x languages)."""
    rows = docs.where(F.col("lang").isNotNull() & allowed & (F.length(F.trim("lang")) > 0))
    # One row per language: as few as there are languages. Counted first, so that the texts needn't be dealt by language.
    rates = stored(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_lang)) / F.count(F.lit(1))).alias("rate")), "languages")
    unit = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.select("lang", text_or_empty("text").alias("text"), unit.alias("u")).join(small(rates)[0], "lang").where("u < rate").select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    if not langs:
        return {"langs": [], "logs": np.zeros((BUCKETS, 0), np.float32)}
    table_ = np.full((BUCKETS, len(langs)), SMOOTHING)
    table_[counts["bucket"], pd.Categorical(counts["lang"], langs).codes] += counts["n"]
    return {"langs": langs, "logs": np.log(table_ / table_.sum(0)).astype(np.float32)}


def score_texts(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """Best language of each text and its posterior (uniform priors): sparse counts times the matrix of log probabilities."""
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model["langs"] else []
    found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    total = np.zeros((len(known), len(model["langs"])))
    for first, doc, bucket, n in bags([texts[i] for i in known]):
        begins = np.flatnonzero(np.diff(doc, prepend=-1))
        total[first + doc[begins]] = np.add.reduceat(n[:, None] * model["logs"][bucket].astype(np.float64), begins)
    if known:
        best = total.argmax(1)
        score[known] = 1 / np.exp(np.clip(total - total.max(1, keepdims=True), -700, 0)).sum(1)
        for i, k in zip(known, best):
            found[i] = model["langs"][k]
    return found, score


def predicted(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, score = score_texts(batch.column(text).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.select(*names).schema.add("lang_pred", "string").add("score", "double"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, remainder("doc_id", 3) != 1)
    out = predicted(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
