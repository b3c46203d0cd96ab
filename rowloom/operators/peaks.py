"""Peaks of profiles: half-height centres, window peaks, lateral peaks. A profile is the rows of one key in an order; all is window
expressions and aggregates per profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.operators import sequence as Q


def half_height_centers(df: DataFrame, by: list[str], order: str, value: str, peak: str, period: float) -> DataFrame:
    """by, centre: the middle between the two places where a profile falls below half the height of its peak (at the place `peak`, a
    column). The base is the mean of the least values on its two sides within 0.9 periods; places between samples by straight lines.
    Null where the profile does not fall so far on both sides."""
    reach = max(2, round(0.9 * period))
    w = Window.partitionBy(*by).orderBy(order)
    s = df.where(F.abs(F.col(order) - F.col(peak)) <= reach).select(*by, F.col(order).alias("_i"), F.col(value).alias("_v"), F.col(peak).alias("_k"), F.lag(value).over(w).alias("_before"), F.lead(value).over(w).alias("_after"))
    left, right = F.col("_i") < F.col("_k"), F.col("_i") > F.col("_k")
    level = s.groupBy(*by).agg(F.min(F.when(left, F.col("_v"))).alias("_a"), F.min(F.when(right, F.col("_v"))).alias("_b"), F.max(F.when(F.col("_i") == F.col("_k"), F.col("_v"))).alias("_top"))
    level = level.select(*by, (0.5 * (F.col("_top") + 0.5 * (F.col("_a") + F.col("_b")))).alias("_level"))
    s = s.join(level, by).where("_v < _level")
    # The nearest low places; beside them, towards the peak, the profile is at the level or over it. Farther out it may be flat: no division there.
    x_left = F.max(F.when(left, F.struct("_i", (F.col("_i") + F.try_divide(F.col("_level") - F.col("_v"), F.col("_after") - F.col("_v"))).alias("x"))))
    x_right = F.min(F.when(right, F.struct("_i", (F.col("_i") - 1 + F.try_divide(F.col("_before") - F.col("_level"), F.col("_before") - F.col("_v"))).alias("x"))))
    found = s.groupBy(*by).agg(x_left.alias("_l"), x_right.alias("_r"))
    return level.join(found, by, "left").select(*by, (0.5 * (F.col("_l.x") + F.col("_r.x"))).alias("centre"))


def window_peaks(df: DataFrame, by: list[str], order: str, value: str, sigma: float, least_known: float = 0.7) -> DataFrame:
    """by, at, height, prominence: the first maximum of each smoothed profile, and its height over the profile's lower quartile.
    Unknown values count as the least known one; a profile of which less than `least_known` is known has no peak."""
    every = Window.partitionBy(*by)
    s = df.select(*by, order, F.coalesce(F.col(value), F.min(value).over(every)).alias("_v"), F.avg(F.col(value).isNotNull().cast("int")).over(every).alias("_known")).where(F.col("_known") >= least_known)
    s = s.select(*by, order, Q.gaussian("_v", by, order, sigma).alias("_s"))
    top = F.max(F.struct(F.col("_s").alias("s"), (-F.col(order)).alias("back")))
    return s.groupBy(*by).agg(top.alias("_t"), F.percentile("_s", F.lit(0.25)).alias("_q")).select(*by, (-F.col("_t.back")).alias("at"), F.col("_t.s").alias("height"), (F.col("_t.s") - F.col("_q")).alias("prominence"))


def clear_peaks(peaks: DataFrame, by: list[str], share: float = 0.35, least: int = 6, reference: Column | None = None) -> DataFrame:
    """The peaks whose prominence is `share` of the reference or more (their upper quartile, if none is given), of those keys that have
    `least` of them (P9)."""
    ref = peaks.groupBy(*by).agg(F.percentile("prominence", F.lit(0.75)).alias("_ref"))
    p = peaks.join(ref, by).where(F.col("prominence") >= share * (F.col("_ref") if reference is None else reference)).drop("_ref")
    enough = p.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(*by)
    return p.join(enough, by, "left_semi")


def lateral_peaks(df: DataFrame, by: list[str], along: str, lateral: str, value: str, length: int, need: float) -> DataFrame:
    """by, win, at, lateral: in stretches of `length` places the lateral place with the greatest mean, the first of equals, where it stands
    out from the least by `need` and every lateral place has half of the stretch known (W17)."""
    win = F.floor(F.col(along) / length)
    s = df.groupBy(*by, win.alias("win"), lateral).agg(F.avg(value).alias("_m"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_all"))
    best = F.max(F.struct(F.col("_m").alias("m"), (-F.col(lateral)).alias("back")))
    w = s.groupBy(*by, "win").agg(best.alias("_b"), F.min("_m").alias("_least"), F.min("_n").alias("_n"), F.max("_all").alias("_all"))
    w = w.where((F.col("_n") >= 0.5 * F.col("_all")) & (F.col("_b.m") - F.col("_least") >= need))
    return w.select(*by, "win", (F.col("win") * length + F.col("_all") / 2).alias("at"), (-F.col("_b.back")).alias("lateral"))
