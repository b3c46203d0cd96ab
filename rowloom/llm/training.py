"""A bounded sample of labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import stored, text_or_empty


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int) -> DataFrame:
    """doc_id, text, y of at most `bound` labelled documents that `allowed` (over doc_id) lets in, stored.

    The ids are chosen by the order of a hash, from all labels; each partition keeps `bound` ids at most.
    Their table has a proven bound, so it is broadcast. An id with more labels counts as 1 if any of them is 1; an id
    with more texts counts once, with the least of them in order."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(bound)
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    return stored(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "labelled")
