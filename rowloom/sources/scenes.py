"""Closed-form striped scenes with known truth: rows at a bearing, a spacing and a phase, with failures."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import expr as X


@dataclass(frozen=True)
class Scene:
    height: int = 192
    width: int = 192
    angle: float = 30.0
    period: float = 12.0
    phase: float = 3.0
    #: (row number, first, last) along the row, in pixels.
    gaps: tuple[tuple[int, float, float], ...] = ((2, 60.0, 90.0), (5, 100.0, 130.0), (-3, 70.0, 95.0))
    noise: float = 6.0
    lots: tuple[int, ...] = field(default=(0,))


def pixels(spark: SparkSession, s: Scene = Scene()) -> DataFrame:
    """lot, r, c, red, green, blue, valid. Noise is a hash of the place, so a scene is the same on every run."""
    lots = F.array(*[F.lit(k) for k in s.lots])
    p = spark.range(s.height).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(s.width - 1).cast("long"))).alias("c"), lots.alias("_l")).select(F.explode("_l").alias("lot"), "r", "c")
    x, y = F.col("c") + 0.5, F.col("r") + 0.5
    t, u = X.across(x, y, s.angle), X.along(x, y, s.angle)
    k = F.rint((t - s.phase) / s.period)
    gap = F.lit(False)
    for row, a, b in s.gaps:
        gap = gap | ((k == row) & u.between(a, b))
    g = F.when(gap, F.lit(0.0)).otherwise(0.5 * (1 + F.cos(2 * math.pi * (t - s.phase) / s.period)))
    n = (F.pmod(F.xxhash64("lot", "r", "c"), F.lit(2001)) / 1000.0 - 1) * s.noise
    return p.select("lot", "r", "c", (110 - 40 * g + n).alias("red"), (110 + 40 * g + n).alias("green"), (110 - 40 * g + n).alias("blue"), F.lit(True).alias("valid"))


def truth(spark: SparkSession, s: Scene = Scene()) -> list[tuple[int, float, float]]:
    return sorted(s.gaps)


def grid(size: int = 224) -> list[Scene]:
    """Scenes of other directions, spacings, phases and noise, one per lot. Each has three gaps in rows near its middle, with several
    spacings of row on both sides."""
    out = []
    for lot, (angle, period, phase, noise) in enumerate(((30.0, 12.0, 3.0, 6.0), (75.0, 9.0, 1.0, 10.0), (120.0, 15.0, 4.5, 25.0), (0.0, 10.0, 2.0, 3.0), (163.0, 13.0, 8.0, 15.0))):
        a = math.radians(angle)
        t, u = size / 2 * (math.cos(a) - math.sin(a)), size / 2 * (math.cos(a) + math.sin(a))
        row = round((t - phase) / period)
        gaps = tuple((row + k, round(u) + float(first), round(u) + float(first + length)) for k, first, length in ((0, -15, 34), (2, 8, 30), (-3, -30, 32)))
        out.append(Scene(size, size, angle, period, phase, gaps, noise, (lot,)))
    return out
