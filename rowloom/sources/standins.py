"""The driver's tables as rasters, series, intervals, segments, votes and lots, for the queries; each with its SQL twin.

A raster is the table embeddings: row = vec_id, and each three elements are a pixel's bands. A series is the mean of
events per user and day. Intervals are the spans of lineitem per supplier, segments those of an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.operators import aggregate as A

PIXELS_PER_ROW = 21
DAY0 = "2024-01-01"
#: Means of so many values are sums in the order of the file, as in SQL with one thread; those of more are exact.
FEW = 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c, red, green, blue, nir, valid."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("r"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(PIXELS_PER_ROW - 1))).alias("c"))
    band = lambda k: F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + 400 * F.get("embedding", 3 * F.col("c") + k).cast("double")))
    p = e.select("r", "c", band(0).alias("red"), band(1).alias("green"), band(2).alias("blue"), F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 - 400 * F.get("embedding", F.lit(63)).cast("double") + 10 * F.col("c"))).alias("nir"))
    return p.withColumn("valid", (F.col("red") + F.col("green") + F.col("blue")) / 3 >= 30)


# DuckDB's names don't know case, so its twin names the bands pr, pg, pb, pn.
PIXELS_SQL = """pixel AS (
  SELECT *, (pr + pg + pb) / 3 >= 30 AS valid FROM (
    SELECT vec_id AS r, c,
      least(255.0::DOUBLE, greatest(0.0::DOUBLE, 128 + 400 * embedding[3 * c + 1]::DOUBLE)) AS pr,
      least(255.0::DOUBLE, greatest(0.0::DOUBLE, 128 + 400 * embedding[3 * c + 2]::DOUBLE)) AS pg,
      least(255.0::DOUBLE, greatest(0.0::DOUBLE, 128 + 400 * embedding[3 * c + 3]::DOUBLE)) AS pb,
      least(255.0::DOUBLE, greatest(0.0::DOUBLE, 128 - 400 * embedding[64]::DOUBLE + 10 * c)) AS pn
    FROM embeddings, unnest(range(0, 21)) AS t(c)))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, i (day), v: the mean value of each user and day; every row has all days from its first to its last."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("row_id"), F.datediff("ts", F.lit(DAY0)).alias("i"), "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    daily = A.exact_means(e, ["row_id", "i"], "value", "v", FEW, ["_file", "_at"])
    # Each day stands for itself and the empty days up to the next: one scan, and no join with a grid of days.
    nxt = F.lead("i").over(Window.partitionBy("row_id").orderBy("i"))
    days = daily.select("row_id", F.col("i").alias("_i"), "v", F.coalesce(nxt - 1, F.col("i")).alias("_to"))
    days = days.select("row_id", "_i", "v", F.explode(F.sequence("_i", "_to")).alias("i"))
    return days.select("row_id", "i", F.when(F.col("i") == F.col("_i"), F.col("v")).alias("v"))


SERIES_SQL = """daily AS (
  SELECT user_id AS row_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS i, avg(value) AS v FROM events GROUP BY ALL
), span AS (SELECT row_id, min(i) AS lo, max(i) AS hi FROM daily GROUP BY row_id
), series AS (
  SELECT g.row_id, g.i, v FROM (SELECT row_id, unnest(range(lo, hi + 1))::INT AS i FROM span) g LEFT JOIN daily d ON d.row_id = g.row_id AND d.i = g.i)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, a, b: from the day of shipping on, one day per unit (both ends belong to it)."""
    li = read(spark, sf_dir, "lineitem")
    a = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double")
    return li.select(F.col("l_suppkey").alias("row_id"), a.alias("a"), (a + F.col("l_quantity") / 5).alias("b"))


INTERVALS_SQL = """iv AS (
  SELECT l_suppkey AS row_id, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE AS a,
    date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE + l_quantity / 5 AS b FROM lineitem)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seg_id, lot_id, x1, y1, x2, y2: one per order with two lines or more."""
    li = read(spark, sf_dir, "lineitem")
    d = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double")
    s = li.groupBy(F.col("l_orderkey").alias("seg_id")).agg(F.min(F.col("l_suppkey").cast("double")).alias("x1"), F.min(d).alias("y1"), F.max(F.col("l_suppkey").cast("double")).alias("x2"), F.max(d).alias("y2"), F.count(F.lit(1)).alias("n"))
    return s.where("n > 1").select("seg_id", (F.col("seg_id") % 25).cast("int").alias("lot_id"), "x1", "y1", "x2", "y2")


SEGMENTS_SQL = """seg AS (
  SELECT l_orderkey AS seg_id, (l_orderkey % 25)::INT AS lot_id, min(l_suppkey)::DOUBLE AS x1, min(date_diff('day', DATE '1992-01-01', l_shipdate::DATE))::DOUBLE AS y1,
    max(l_suppkey)::DOUBLE AS x2, max(date_diff('day', DATE '1992-01-01', l_shipdate::DATE))::DOUBLE AS y2
  FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, ang, per, ring."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("src"), F.pmod(F.col("p_retailprice"), F.lit(180.0)).alias("ang"), F.col("p_size").cast("double").alias("per"), F.col("p_retailprice").alias("ring"))


VOTES_SQL = """vote AS (
  SELECT p_partkey AS id, p_brand AS src, p_retailprice - 180.0::DOUBLE * floor(p_retailprice / 180.0::DOUBLE) AS ang, p_size::DOUBLE AS per, p_retailprice AS ring FROM part)"""
