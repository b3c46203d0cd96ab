"""The corpus pipeline: from documents to token ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. What it returns is written as Parquet and read again as
the next stage's docs, so a lost executor costs one stage at most. All but the last return the columns of docs.

1. quality_rules: drops texts that break the rules, and those of hosts whose shrunk failure rate is too high.
2. toxicity: drops texts whose noisy-or score is 0.5 or more.
3. neardup: keeps the document with the least doc_id of each class of near duplicates.
4. decontaminate: drops documents in which a window of the benchmark occurs.
5. bpe: doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them.

Cases: null and empty texts go in the first stage, as they have too few words; documents with a null id are documents like others; rows
that are equal in id and text are one document after the third stage; texts may be of any length; other columns are kept until the last
stage; empty tables of documents, labels or benchmark give no rows, no verdict and no hit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import bpe, decontaminate, neardup, quality_rules, toxicity
from rowloom.llm.common import shared_dir

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("toxicity", toxicity.stage),
    ("neardup", neardup.stage),
    ("decontaminate", decontaminate.stage),
    ("bpe", bpe.stage),
]

#: Toxicity, near duplicates and BPE can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the whole table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
