"""What the operators of this subpackage share: reading, shared storage, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word patterns: space, tab, \n, \v, \f, \r.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is set here only where the session has none and all run in one
    process; on a cluster a folder of the driver's own machine would be of no use, so that is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="rowloom-")
        sc.setCheckpointDir(at)
    return at


#: Where the tables lie that stored() has made.
_AT: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: cuts the lineage, keeps column
    pruning and sizes, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _AT[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_AT.pop(df))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, rows: int = 200_000, size: Column | None = None, most: int = 1 << 26) -> tuple[DataFrame, bool]:
    """df marked for broadcast if its counted rows, and the sum of their `size` in bytes where their columns have no bound, stay
    within the bounds, else as it is. df must be cheap to count (stored). Beyond the bounds Spark shuffles the join."""
    got = df.select((F.lit(0) if size is None else size).alias("size")).limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held")).first()
    fits = got["n"] <= rows and (got["held"] or 0) <= most
    return (F.broadcast(df) if fits else df), fits


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "utf-8")) % n


def text_or_empty(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))
