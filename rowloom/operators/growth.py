"""Rows that grow plant by plant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(df: DataFrame, by: list[str], periods: float) -> DataFrame:
    """by, a, b, per: intervals of a group that are `periods` periods (column per) apart or less, as one."""
    w = Window.partitionBy(*by).orderBy("a", "b")
    end = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("a") - end > periods * F.col("per")).cast("int"), F.lit(1))
    runs = df.select(*by, "a", "b", "per", new.alias("_new")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("per").alias("per")).drop("_run")


def by_plants(rows: DataFrame, plants: DataFrame, by: list[str], near: float = 1.0, alone: float = 3.0, gap: float = 2.4, least: float = 3.0) -> DataFrame:
    """by, a, b, per: intervals of rows, prolonged and joined by plants (both by, a, b, per; all lengths in periods). Plants not more than `near`
    apart are a sequence. One that is as near to an interval belongs to it; another counts if it is `alone` long. What is then not more than
    `gap` apart is one interval, if it is `least` long. A lone tree behind a row's end is no sequence, so it doesn't prolong it."""
    both = rows.select(*by, "a", "b", "per", F.lit(True).alias("_own")).unionByName(merged(plants, by, near).withColumn("_own", F.lit(False)))
    w = Window.partitionBy(*by).orderBy("a", "b", "_own")
    before = F.max(F.when(F.col("_own"), F.col("b"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("_own"), F.col("a"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    reach = near * F.col("per")
    kept = F.col("_own") | (F.col("a") - before <= reach) | (after - F.col("b") <= reach) | (F.col("b") - F.col("a") >= alone * F.col("per"))
    both = both.withColumn("_kept", F.coalesce(kept, F.lit(False))).where("_kept")
    return merged(both, by, gap).where(F.col("b") - F.col("a") >= least * F.col("per"))
