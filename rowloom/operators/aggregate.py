"""Aggregates over bins, rows and windows. Each is one partial and one final aggregate unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.functions import expr as X


def binned_profile(df: DataFrame, by: list[str], position: str | Column, value: str | Column, width: float, origin: float = 0.0) -> DataFrame:
    """by, bin, v (mean), n: the mean of a value per bin of a position."""
    p = F.col(position) if isinstance(position, str) else position
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, X.bin_of(p, origin, width).alias("bin"), v.alias("_v")).where(F.col("_v").isNotNull() & F.col("bin").isNotNull())
    return rows.groupBy(*by, "bin").agg(F.avg("_v").alias("v"), F.count(F.lit(1)).alias("n"))


def profile_contrast(profile: DataFrame, by: list[str]) -> DataFrame:
    """by, contrast: the variance of a profile, each bin weighted by its count."""
    s = profile.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("v")).alias("_s"), F.sum(F.col("n") * F.col("v") * F.col("v")).alias("_q"))
    return s.select(*by, (F.col("_q") / F.col("_n") - F.pow(F.col("_s") / F.col("_n"), 2)).alias("contrast"))


#: Steps of a fixed grid. A value's rest after one is at most 2^31 of the next, so counts of steps add up in a long without rounding.
GRID = (2.0**31, 1.0, 2.0**-32, 2.0**-64)


def ordered_means(df: DataFrame, by: list[str], value: str, name: str, order: list[str], few: int) -> DataFrame:
    """by and the mean of a group's known values, added one by one in their order, however the rows were split; groups of more than `few`
    values, and those without any, are left out. No task is sent more than few + 1 rows of a group by another."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = df.where(F.col(value).isNotNull()).select(*by, F.row_number().over(w).alias("_k"), F.sum(F.col(value).cast("double")).over(w).alias("_sum")).where(F.col("_k") <= few + 1)
    last = known.groupBy(*by).agg(F.max(F.struct("_k", "_sum")).alias("_last"))
    return last.where(F.col("_last._k") <= few).select(*by, (F.col("_last._sum") / F.col("_last._k")).alias(name))


def exact_means(df: DataFrame, by: list[str], value: str, name: str, few: int = 0, order: list[str] | None = None) -> DataFrame:
    """by and the mean of a group's known doubles, rounded once: the same in whatever order rows come, and for copies of all of them, which
    a mean that is compared with a threshold must be. One partial and one final aggregate, as a plain mean.

    Each value is cut into whole multiples of four steps; their sums are long. The total is then two doubles, and the quotient is mended
    by its remainder. Groups whose greatest absolute value is under 2^-12 or from 2^62 on (or none), and those of `few` values or less, have
    the plain mean; with an order the latter have that of their values added in it (`ordered_means`)."""
    v, size = F.col("_v"), F.abs("_v")
    cut = df.select(*by, F.col(value).cast("double").alias("_v")).withColumn("_x", F.when(size < 2.0**62, v))
    for k, step in enumerate(GRID):
        cut = cut.withColumn(f"_p{k}", F.rint(F.col("_x") / step)).withColumn("_x", F.col("_x") - F.col(f"_p{k}") * step)
    s = cut.groupBy(*by).agg(*[F.sum(F.col(f"_p{k}").cast("long")).alias(f"_p{k}") for k in range(len(GRID))], F.count("_v").alias("_n"), F.max(size).alias("_size"), F.avg("_v").alias("_plain"))
    low = 2**32 - 1
    s = s.withColumn("_p2", F.col("_p2") + F.shiftright("_p3", 32)).withColumn("_p3", F.col("_p3").bitwiseAND(F.lit(low)))
    s = s.withColumn("_p1", F.col("_p1") + F.shiftright("_p2", 32)).withColumn("_p2", F.col("_p2").bitwiseAND(F.lit(low)))
    s = s.select(*by, F.when(F.col("_n") > 0, F.col("_n").cast("double")).alias("_n"), "_size", "_plain", (F.col("_p0") * GRID[0] + F.col("_p1")).alias("_whole"), (F.col("_p2") * GRID[2] + F.col("_p3") * GRID[3]).alias("_part"))
    s = s.withColumn("_sum", F.col("_whole") + F.col("_part")).withColumn("_lost", F.col("_part") - (F.col("_sum") - F.col("_whole")))
    # The quotient's upper half times the count is exact, and so is the lower's.
    s = s.withColumn("_q", F.col("_sum") / F.col("_n")).withColumn("_t", F.col("_q") * (2.0**27 + 1)).withColumn("_up", F.col("_t") - (F.col("_t") - F.col("_q")))
    rest = F.col("_sum") - F.col("_up") * F.col("_n") - (F.col("_q") - F.col("_up")) * F.col("_n") + F.col("_lost")
    mean = F.when((F.col("_n") > few) & (F.col("_size") >= 2.0**-12) & (F.col("_size") < 2.0**62), F.col("_q") + rest / F.col("_n")).otherwise(F.col("_plain"))
    if order is None:
        return s.select(*by, mean.alias(name))
    return s.where(F.col("_n").isNull() | (F.col("_n") > few)).select(*by, mean.alias(name)).unionByName(ordered_means(df, by, value, name, order, few))


def fourier(df: DataFrame, by: list[str], position: str, value: str, period: Column, weight: Column | None = None) -> DataFrame:
    """by, amplitude, phase of one frequency: two weighted sums per group."""
    w = F.lit(1.0) if weight is None else weight
    a = F.lit(X.TWO_PI) * F.col(position) / period
    s = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.sum(w * F.col(value) * F.cos(a)).alias("_c"), F.sum(w * F.col(value) * F.sin(a)).alias("_s"), F.sum(w).alias("_w"))
    return s.select(*by, F.try_divide(F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")), F.col("_w")).alias("amplitude"), F.atan2(-F.col("_s"), F.col("_c")).alias("phase"))


def autocorrelation(series: DataFrame, by: list[str], order: str, value: str, lags: int) -> DataFrame:
    """lag, r: the products of values lag apart, pooled over all groups and normalised; one self-join on group and place."""
    mean = series.groupBy(*by).agg(F.avg(value).alias("_m"))
    s = series.join(mean, by).where(F.col(value).isNotNull()).select(*by, F.col(order).alias("_i"), (F.col(value) - F.col("_m")).alias("_x"))
    ahead = s.select(*by, F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "_i", F.col("_x").alias("_y")).withColumn("_i", F.col("_i") - F.col("lag"))
    pairs = s.join(ahead, [*by, "_i"]).groupBy("lag").agg(F.sum(F.col("_x") * F.col("_y")).alias("_p"), F.sum(F.col("_x") * F.col("_x")).alias("_q"))
    return pairs.select("lag", F.try_divide(F.col("_p"), F.col("_q")).alias("r"))


def ols(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, slope, intercept, se (of the slope), mid (fit at the middle of x), significant: slope over twice its error."""
    s = df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("_xx"), F.regr_syy(y, x).alias("_yy"), F.regr_sxy(y, x).alias("_xy"), F.avg(F.when(F.col(y).isNotNull(), F.col(x))).alias("_mx"),
    )
    rss = F.greatest(F.col("_yy") - F.col("slope") * F.col("_xy"), F.lit(0.0))
    s = s.withColumn("se", F.when(F.col("n") > 2, F.sqrt(F.try_divide(rss / F.when(F.col("n") > 2, F.col("n") - 2), F.col("_xx")))))
    return s.select(*by, "n", "slope", "intercept", "se", (F.col("intercept") + F.col("slope") * F.col("_mx")).alias("mid"), F.coalesce(F.abs("slope") > 2 * F.col("se"), F.lit(False)).alias("significant"))


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n: the most frequent value, the least of equals. Counts first, so only distinct values are ranked."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))
    return n.withColumn("_k", first).where("_k = 1").drop("_k")


def levels(df: DataFrame, by: list[str], value: str, **percents: float) -> DataFrame:
    """by and one column per named exact percentile (linear between values)."""
    return df.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(name) for name, p in percents.items()])


#: Values that the bounds of a percentile are apart in rank, as a share of all: 1 / ACCURACY is what the sketch may be wrong by.
ACCURACY = 10_000


def whole_levels(df: DataFrame, value: str, **percents: float) -> DataFrame:
    """One row with a column per named exact percentile (linear between values) of all rows; null where there are none.

    A sketch bounds each percentile; then values below and above the bounds are only counted, and those between them (less than a
    thousandth of all) are counted one by one and ranked. So no task holds all distinct values, as a plain percentile would."""
    e = 3 / ACCURACY
    v = F.col("_v")
    rows = df.select(F.col(value).cast("double").alias("_v")).where(v.isNotNull())
    bounds = rows.agg(*[F.percentile_approx("_v", [max(0.0, p - e), min(1.0, p + e)], ACCURACY).alias(name) for name, p in percents.items()])
    sides = [F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), F.when(v < F.get(name, F.lit(0)), -1).when(v > F.get(name, F.lit(1)), 1).otherwise(0).alias("side")) for name, p in percents.items()]
    t = rows.join(F.broadcast(bounds)).select("_v", F.explode(F.array(*sides)).alias("x")).select("_v", "x.*")
    t = t.groupBy("name", "p", "side", F.when(F.col("side") == 0, v).alias("_key")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w = Window.partitionBy("name")
    order = w.orderBy("side", "_key")
    t = t.select("name", F.sum("n").over(order).alias("_end"), "n", (F.col("p") * (F.sum("n").over(w) - 1)).alias("at"), F.when(F.col("side") < 0, F.col("_hi")).otherwise(F.col("_lo")).alias("_v"))
    has = lambda k: (F.col("_end") > k) & (F.col("_end") - F.col("n") <= k)
    low, high = (F.max(F.when(has(k), v)) for k in (F.floor("at"), F.ceil("at")))
    share = F.first(F.col("at") - F.floor("at"))
    out = t.groupBy("name").agg((low + (high - low) * share).alias("_v"))
    return out.agg(*[F.max(F.when(F.col("name") == name, v)).alias(name) for name in percents])


def window_means(series: DataFrame, by: list[str], order: str, value: str, width: int, low: float) -> DataFrame:
    """by, win, z, presence, failing: a series in windows of `width` places. A last window of less than half the width goes
    to the one before it; z is null where less than half is known."""
    all_ = Window.partitionBy(*by)
    s = series.withColumns({"_lo": F.min(order).over(all_), "_hi": F.max(order).over(all_)})
    n = F.col("_hi") - F.col("_lo") + 1
    last = F.greatest(F.floor(n / width) - F.when(F.pmod(n, F.lit(width)) * 2 >= width, F.lit(0)).otherwise(F.lit(1)), F.lit(0))
    s = s.withColumn("win", F.least(F.floor((F.col(order) - F.col("_lo")) / width), last))
    w = s.groupBy(*by, "win").agg(F.avg(value).alias("_z"), F.count(value).alias("_k"), F.count(F.lit(1)).alias("_n"), F.avg((F.col(value) >= low).cast("double")).alias("_p"), F.avg((F.col(value) < low).cast("double")).alias("_f"))
    known = F.col("_k") * 2 >= F.col("_n")
    return w.select(*by, "win", F.when(known, F.col("_z")).alias("z"), F.when(known, 100 * F.col("_p")).alias("presence"), F.when(known, F.col("_f") >= 0.5).alias("failing"))


def ring_median(df: DataFrame, by: list[str], radius: str | Column, value: str, floor: float = 1e-30) -> DataFrame:
    """by, ring, m: median per whole radius."""
    r = F.col(radius) if isinstance(radius, str) else radius
    return df.withColumn("ring", F.rint(r).cast("int")).groupBy(*by, "ring").agg(F.greatest(F.percentile(value, F.lit(0.5)), F.lit(floor)).alias("m"))
