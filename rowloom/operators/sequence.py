"""Operators on ordered series: windows, islands, thresholds with hysteresis, intervals.

Every window is partitioned by the row (or block), so a series is never put in one task with others it has nothing to
do with, and none is global.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def ordered(by: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def box_mean(value: Column, w: WindowSpec, before: int, after: int) -> Column:
    """Mean of the known values of a frame; what lies outside the series doesn't count."""
    return F.avg(value).over(w.rowsBetween(-before, after))


def gaussian_weights(sigma: float, cut: float = 3.0) -> list[float]:
    radius = max(1, int(math.ceil(cut * sigma)))
    g = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(g) for x in g]


def gaussian(value: str, by: list[str], order: str, sigma: float) -> Column:
    """Gaussian smoothing; the ends are continued with the first and the last value."""
    w = ordered(by, order)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(all_), F.last(value).over(all_)
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    out = F.lit(0.0)
    for k, g in zip(range(-radius, radius + 1), weights):
        x = F.col(value) if k == 0 else F.coalesce(F.lag(value, -k).over(w), first) if k < 0 else F.coalesce(F.lead(value, k).over(w), last)
        out = out + F.lit(g) * x
    return out


def moving_median(value: str, by: list[str], order: str, half: int) -> Column:
    """Median of the known values in ±half places; null where less than half of the frame is known."""
    f = ordered(by, order).rowsBetween(-half, half)
    return F.when(F.count(value).over(f) * 2 >= 2 * half + 1, F.percentile(value, F.lit(0.5)).over(f))


def local_maximum(value: str, by: list[str], order: str, half: int) -> Column:
    """The greatest in ±half places, and greater than the value before it."""
    w = ordered(by, order)
    top = F.max(value).over(w.rowsBetween(-half, half))
    before = F.lag(value).over(w)
    return (F.col(value) >= top) & (before.isNull() | (F.col(value) > before))


def prominence(value: str, by: list[str], order: str, half: int) -> Column:
    """Height over the higher of the two minima to the left and the right within half places."""
    w = ordered(by, order)
    left, right = F.min(value).over(w.rowsBetween(-half, 0)), F.min(value).over(w.rowsBetween(0, half))
    return F.col(value) - F.greatest(left, right)


def islands(df: DataFrame, by: list[str], order: str, flag: str | Column, gap: int = 0, aggregates: dict[str, Column] | None = None) -> DataFrame:
    """by, first, last, n: the runs of places with the flag; runs at most `gap` places apart are one. Two windows of the
    same order share one sort; runs are then aggregated where they are."""
    on = df.where(F.col(flag) if isinstance(flag, str) else flag)
    w = ordered(by, order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap + 1).cast("int"), F.lit(1))
    runs = on.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    made = [c.alias(k) for k, c in (aggregates or {}).items()]
    return runs.groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), *made).drop("_run")


def hysteresis(df: DataFrame, by: list[str], order: str, weak: Column, strong: Column, gap: int = 0) -> DataFrame:
    """by, first, last, n: runs of weak places in which a strong one lies."""
    return islands(df.withColumn("_strong", strong), by, order, weak, gap, {"_any": F.max(F.col("_strong").cast("int"))}).where("_any = 1").drop("_any")


def merge_intervals(df: DataFrame, by: list[str], a: str = "a", b: str = "b", gap: float = 0.0) -> DataFrame:
    """by, a, b, n: intervals at most `gap` apart are one."""
    w = Window.partitionBy(*by).orderBy(a, b)
    end = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(a) - end > gap).cast("int"), F.lit(1))
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run").agg(F.min(a).alias("a"), F.max(b).alias("b"), F.count(F.lit(1)).alias("n")).drop("_run")


def half_height_trim(df: DataFrame, by: list[str], order: str, value: str, end: int, least: float = 1.0) -> DataFrame:
    """by, first, last: what is left of each series when its two ends are cut where they stay below half the median of the
    first and the last `end` places (`least` at least). Series of no more than two ends are left as they are."""
    w = Window.partitionBy(*by)
    k = F.row_number().over(w.orderBy(order))
    n = F.count(F.lit(1)).over(w)
    s = df.withColumn("_k", k).withColumn("_n", n)
    lim = s.groupBy(*by).agg(
        F.greatest(F.lit(least), 0.5 * F.percentile(F.when(F.col("_k") <= end, F.col(value)), F.lit(0.5))).alias("_l"),
        F.greatest(F.lit(least), 0.5 * F.percentile(F.when(F.col("_k") > F.col("_n") - end, F.col(value)), F.lit(0.5))).alias("_r"),
    )
    s = s.join(lim, by)
    short = F.col("_n") <= 2 * end
    return s.groupBy(*by).agg(F.min(F.when(short | (F.col(value) >= F.coalesce("_l", F.lit(least))), F.col(order))).alias("first"), F.max(F.when(short | (F.col(value) >= F.coalesce("_r", F.lit(least))), F.col(order))).alias("last"))


def width_at(df: DataFrame, by: list[str], order: str, value: str, base: str, fraction: float = 0.6) -> DataFrame:
    """by, first, last, width: the run around each series' maximum that stays over base + fraction of its height."""
    top = df.groupBy(*by).agg(F.max(value).alias("_top"), F.min(base).alias("_base"))
    s = df.join(top, by)
    at = s.where(F.col(value) == F.col("_top")).groupBy(*by).agg(F.min(order).alias("_at"))
    s = s.join(at, by)
    runs = islands(s, by, order, F.col(value) >= F.col("_base") + fraction * (F.col("_top") - F.col("_base")), 0, {"_at": F.first("_at")})
    return runs.where("first <= _at AND _at <= last").select(*by, "first", "last", F.col("n").alias("width"))


def interpolated(df: DataFrame, by: list[str], order: str, value: str) -> Column:
    """Unknown values between known ones by a straight line; before the first and after the last, the nearest."""
    w = ordered(by, order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("i"), F.col(value).alias("v")))
    p = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    q = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    between = p["v"] + (q["v"] - p["v"]) * (F.col(order) - p["i"]) / F.when(q["i"] > p["i"], q["i"] - p["i"])
    return F.when(F.col(value).isNotNull(), F.col(value)).when(p.isNull(), q["v"]).when(q.isNull(), p["v"]).otherwise(between)


def alternation(df: DataFrame, by: list[str], order: str, value: str, least: float) -> DataFrame:
    """by, pairs, large, opposite: shares of successive differences that are large, and of those that change their sign."""
    w = ordered(by, order)
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(w)).where("_d IS NOT NULL")
    d = d.withColumn("_o", F.signum("_d") * F.signum(F.lag("_d").over(w)) < 0)
    big = F.abs("_d") >= least
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.avg(big.cast("int")).alias("large"), F.avg(F.when(big, F.col("_o").cast("int"))).alias("opposite"))


def failures(series: DataFrame, by: list[str], order: str, z: str, threshold: float = 0.5, hyst: float = 0.0, close: int = 1, least: int = 2, edge: int = 2, half: int = 1) -> DataFrame:
    """by, first, last, length, level, edge: the stretches in which the running median of z stays below a threshold.

    Low places are those under threshold + hyst; a run needs one under the threshold; runs `close` places apart are one;
    those shorter than `least` go; edge marks runs within `edge` places of an end of the series."""
    all_ = Window.partitionBy(*by)
    s = series.withColumns({"_z": moving_median(z, by, order, half), "_lo": F.min(order).over(all_), "_hi": F.max(order).over(all_)})
    s = s.withColumn("_strong", F.col("_z") < threshold)
    kept = {"level": F.avg("_z"), "_any": F.max(F.col("_strong").cast("int")), "_lo": F.first("_lo"), "_hi": F.first("_hi")}
    runs = islands(s, by, order, F.col("_z") < threshold + hyst, close, kept)
    runs = runs.where("_any = 1").withColumn("length", F.col("last") - F.col("first") + 1).where(F.col("length") >= least)
    at_edge = ((F.col("first") - F.col("_lo") < edge) | (F.col("_hi") - F.col("last") < edge)).cast("int")
    return runs.select(*by, "first", "last", "length", "level", at_edge.alias("edge"))
