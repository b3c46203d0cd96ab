"""Compositions: direction and spacing of rows, their evidence, rows, failures, blocks. All keyed by lot and row.

Per-lot estimates are tables of one row per lot that are joined to the pixels; the pixels themselves are only ever filtered, binned and
aggregated, so a raster of any size is reduced before its first shuffle ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.functions import expr as X
from rowloom.operators import aggregate as A
from rowloom.operators import graph, ordered, raster
from rowloom.operators import joins as J
from rowloom.operators import sequence as Q

#: Lots are few beside pixels: their table is broadcast up to this many rows.
LOT_ROWS = 100_000


def per_lot(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(LOT_ROWS + 1).count() <= LOT_ROWS else df


def _best(df: DataFrame, by: list[str], score: str, *ties: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def work_factor(period_px: float) -> int:
    """How much the raster may be coarsened: about twelve pixels per period stay."""
    return max(1, math.floor(period_px / 12)) if period_px > 24 else 1


#: Least lengths of rows whose failures, and whose plants' spacing, are looked for.
FAILURE_M, SPACING_M = 4.0, 20.0


def long_enough(length, least: float) -> Column:
    """P11; an unknown length is none."""
    return F.coalesce(X._c(length) >= least, F.lit(False))


def index_swap(green: Column, bright: Column, white: Column, forced: Column, stronger: float = 3.0, least_white: float = 1.0) -> Column:
    """(crossed, swapped, ang, per, peak) from what green and brightness (structs ang, per, peak) show (C1). same: one pattern in both.
    crossed: the brightness has another one that stands out (white), across the green's and 1.1 to 3 times as wide, as rows are to their
    plants. The brightness is then used, as where it shows the same pattern more than `stronger` times as strongly, or is asked for."""
    apart, wider = X.angle_diff(green["ang"], bright["ang"]), bright["per"] / green["per"]
    same = F.coalesce((F.abs(bright["per"] - green["per"]) <= 0.1 * green["per"]) & (apart <= 2), F.lit(False))
    crossed = F.coalesce(~same & (white >= least_white) & wider.between(1.1, 3.0) & (apart >= 45), F.lit(False))
    swapped = bright["ang"].isNotNull() & (forced | crossed | (same & (bright["peak"] > stronger * green["peak"])))
    pattern = lambda k: F.when(crossed | (swapped & same), bright[k]).otherwise(green[k]).alias(k)
    return F.struct(crossed.alias("crossed"), swapped.alias("swapped"), pattern("ang"), pattern("per"), pattern("peak"))


def first_guess(px: DataFrame, value: str, size: int = 64, least_period: float = 4.0, most_period: float = 40.0) -> DataFrame:
    """lot, ang, per, ring, frac by a summed spectrum."""
    return raster.orientation(raster.welch(px, value, size), size, least_period, most_period).where("NOT isnan(ang)")


def refined_angle(px: DataFrame, value: str, est: DataFrame, span: float = 1.5) -> DataFrame:
    """est with ang moved to where the profile across has most contrast: 21 candidates, then 11 between the best one's neighbours, twice."""
    step = span / 10
    for n in (10, 5, 5):
        est = per_lot(est.checkpoint())
        cand = px.where("valid").join(est.select("lot", "ang", "per"), "lot").select("lot", "r", "c", F.col(value).alias("v"), "per", F.explode(F.array(*[F.round(F.col("ang") + k * step, 6) for k in range(-n, n + 1)])).alias("a"))
        t = X.across(F.col("c") + 0.5, F.col("r") + 0.5, F.col("a")) / (F.col("per") / 12)
        best = _best(A.profile_contrast(A.binned_profile(cand.withColumn("t", t), ["lot", "a"], "t", "v", 1.0), ["lot", "a"]), ["lot"], "contrast", "a")
        est = est.join(best.select("lot", F.col("a").alias("_a")), "lot").withColumn("ang", F.col("_a")).drop("_a")
        step /= 5
    return est


def refined_period(px: DataFrame, value: str, est: DataFrame) -> DataFrame:
    """est with per (6 % around, in steps of a thousandth) and phase from single frequencies of the profile across. The pixels are binned once."""
    est = per_lot(est.checkpoint())
    rows = px.where("valid").join(est.select("lot", "ang"), "lot")
    prof = A.binned_profile(rows.withColumn("t", X.across(F.col("c") + 0.5, F.col("r") + 0.5, F.col("ang"))), ["lot"], "t", value, 0.25)
    prof = prof.join(est.select("lot", "per"), "lot").withColumn("t", (F.col("bin") + 0.5) * 0.25)
    mean = prof.groupBy("lot").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("_m"))
    prof = prof.join(mean, "lot").withColumn("v", F.col("v") - F.col("_m"))
    scan = prof.withColumn("p", F.explode(F.array(*[F.col("per") * (1 + k / 1000) for k in range(-60, 61)])))
    best = _best(A.fourier(scan, ["lot", "p"], "t", "v", F.col("p"), F.col("n").cast("double")), ["lot"], "amplitude", "p")
    best = best.select("lot", F.col("p").alias("_p"), F.pmod(-F.col("phase") * F.col("p") / X.TWO_PI, F.col("p")).alias("v0"), "amplitude")
    return est.join(best, "lot").withColumn("per", F.col("_p")).drop("_p")


def estimate(px: DataFrame, value: str = "v", size: int = 64) -> DataFrame:
    """lot, ang, per, v0."""
    graph.shared_dir(px)
    return refined_period(px, value, refined_angle(px, value, first_guess(px, value, size)))


def evidence(px: DataFrame, value: str, est: DataFrame) -> DataFrame:
    """lot, row_id, i, per, c, l, r, con, dl, dr, plant: for each row and place along it the mean of its middle and of the stripes beside
    it, and their contrasts, smoothed over one period. One aggregate over the pixels; the rest sees rows * places."""
    p = px.where("valid").join(per_lot(est).select("lot", "ang", "per", "v0"), "lot")
    x, y = F.col("c") + 0.5, F.col("r") + 0.5
    p = p.select("lot", "per", X.across(x, y, F.col("ang")).alias("t"), F.floor(X.along(x, y, F.col("ang"))).alias("i"), F.col(value).alias("v"), "v0")
    p = p.withColumn("row_id", F.rint((F.col("t") - F.col("v0")) / F.col("per")).cast("long"))
    off = (F.col("t") - F.col("v0") - F.col("row_id") * F.col("per")) / F.col("per")
    e = p.groupBy("lot", "row_id", "i").agg(F.first("per").alias("per"), F.avg(F.when(F.abs(off) <= 0.25, F.col("v"))).alias("c"), F.avg(F.when(off <= -0.375, F.col("v"))).alias("l"), F.avg(F.when(off >= 0.375, F.col("v"))).alias("r"))
    by = ["lot", "row_id"]
    u = e.withColumn("u", 60 * F.col("i") / F.col("per"))  # sixtieths of a period: frames take whole numbers
    wide = Window.partitionBy(*by).orderBy("u").rangeBetween(-30, 30)
    narrow = Window.partitionBy(*by).orderBy("u").rangeBetween(-10, 10)
    return u.select(
        *by, "i", "per", "c", "l", "r",
        F.avg(F.col("c") - (F.col("l") + F.col("r")) / 2).over(wide).alias("con"), F.avg(F.col("c") - F.col("l")).over(wide).alias("dl"), F.avg(F.col("c") - F.col("r")).over(wide).alias("dr"),
        F.avg(F.least(F.col("c") - F.col("l"), F.col("c") - F.col("r"))).over(narrow).alias("plant"),
    )


def rows_of(ev: DataFrame, k_sigma: float = 3.0, gap_periods: float = 2.4, least_periods: float = 3.0) -> DataFrame:
    """lot, row_id, a, b: the intervals in which each row is seen (X2): weak runs that hold a strong place, gaps filled, joined and trimmed by length."""
    by = ["lot", "row_id"]
    sigma = ev.groupBy("lot").agg(X.noise_rms("con").alias("sigma"))
    e = ev.join(per_lot(sigma), "lot")
    weak, strong = X.present("con", "dl", "dr", F.col("sigma")), X.present("con", "dl", "dr", k_sigma * F.col("sigma"))
    s = e.select(*by, "i", "per", weak.alias("weak"), strong.alias("strong"))
    runs = Q.islands(s, by, "i", "weak", 2, {"strong": F.sum(F.col("strong").cast("int")), "per": F.first("per")})
    runs = runs.where(F.col("strong") >= F.greatest(F.lit(3.0), F.col("per"))).select(*by, F.col("first").cast("double").alias("a"), F.col("last").cast("double").alias("b"), "per")
    w = Window.partitionBy(*by).orderBy("a", "b")
    end = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("a") - end > gap_periods * F.col("per")).cast("int"), F.lit(1))
    runs = runs.withColumn("_n", new).withColumn("_run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*by, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("per").alias("per"))
    return out.where(F.col("b") - F.col("a") >= least_periods * F.col("per")).select(*by, "a", "b")


def failures_of(ev: DataFrame, rows: DataFrame, threshold: float = 0.5, least: int = 8, close: int = 3, half: int = 2, pixel: float = 1.0) -> DataFrame:
    """lot, row_id, first, last, length, level, edge (X11): stretches between a row's ends where its level, 0 between rows and 1 for a
    typical plant, stays low. Rows of less than FAILURE_M (pixels of `pixel` metres) are left out (P11)."""
    ext = rows.groupBy("lot", "row_id").agg(F.min("a").alias("lo"), F.max("b").alias("hi")).where(long_enough((F.col("hi") - F.col("lo")) * pixel, FAILURE_M))
    e = ev.join(ext, ["lot", "row_id"]).where("i BETWEEN lo AND hi")
    lv = e.groupBy("lot").agg(F.percentile("c", F.lit(0.75)).alias("ref"), F.percentile((F.col("l") + F.col("r")) / 2, F.lit(0.5)).alias("base"))
    z = e.join(per_lot(lv), "lot").select("lot", "row_id", "i", X.normalised("c", "base", "ref").alias("z"))
    return Q.failures(z, ["lot", "row_id"], "i", "z", threshold, 0.0, close, least, 4, half)


def run_scene(px: DataFrame, value: str = "v") -> dict[str, DataFrame]:
    """estimate, evidence, rows and failures of all lots (X3, X4, X13). A lot without a pattern has no rows and doesn't stop the others."""
    est = estimate(px, value).checkpoint()
    ev = evidence(px, value, est).checkpoint()
    rows = rows_of(ev)
    return {"estimate": est, "evidence": ev, "rows": rows, "failures": failures_of(ev, rows)}


def row_f1(found: DataFrame, truth: DataFrame) -> DataFrame:
    """precision, recall, f1 by length: cells (lot, row_id, i) of found and true rows."""
    both = found.select("lot", "row_id", "i").distinct().withColumn("f", F.lit(1)).join(truth.select("lot", "row_id", "i").distinct().withColumn("t", F.lit(1)), ["lot", "row_id", "i"], "full")
    s = both.agg(F.count("f").alias("f"), F.count("t").alias("t"), F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("b"))
    return s.select(F.try_divide("b", "f").alias("precision"), F.try_divide("b", "t").alias("recall"), F.try_divide(2 * F.col("b"), F.col("f") + F.col("t")).alias("f1"))


def two_signal_blocks(px: DataFrame, value: str, size: int = 32, least_period: float = 4.0, most_period: float = 24.0, least_votes: int = 4, hi: float = 0.5, lo: float = 0.3, least_cells: int = 400) -> DataFrame:
    """lot, comp, pattern, cells, r, c (centre): the parts of a raster that have one pattern (X5, X6): votes of windows, clusters of votes, the share of
    the variance that each pattern explains around each cell (at work resolution), the best pattern per cell, and components that reach `hi`."""
    graph.shared_dir(px)
    votes = raster.tile_votes(px, value, size, least_period, most_period)
    groups = per_lot(ordered.vote_clusters(votes, ["lot"], least_votes=least_votes, least_ring=20.0).checkpoint())
    cell = 8
    p = px.where("valid").join(groups.select("lot", "pattern", "ang", "per"), "lot")
    t = X.across(F.col("c") + 0.5, F.col("r") + 0.5, F.col("ang")) / F.col("per") * X.TWO_PI
    v = F.col(value)
    s = p.groupBy("lot", "pattern", F.floor(F.col("r") / cell).alias("r"), F.floor(F.col("c") / cell).alias("c")).agg(F.sum(v * F.cos(t)).alias("x"), F.sum(v * F.sin(t)).alias("y"), F.sum(F.cos(t)).alias("x0"), F.sum(F.sin(t)).alias("y0"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count(F.lit(1)).alias("n"))
    w = lambda *o: Window.partitionBy("lot", "pattern", o[0]).orderBy(o[1]).rangeBetween(-2, 2)
    for a, b in (("r", "c"), ("c", "r")):
        s = s.select("lot", "pattern", "r", "c", *[F.sum(k).over(w(a, b)).alias(k) for k in ("x", "y", "x0", "y0", "s", "q", "n")])
    m = F.col("s") / F.col("n")
    re, im = F.col("x") - m * F.col("x0"), F.col("y") - m * F.col("y0")
    ratio = 2 * (re * re + im * im) / (F.col("n") * F.greatest(F.col("q") - F.col("n") * m * m, F.lit(1e-9)))
    best = s.withColumn("ratio", ratio).groupBy("lot", "r", "c").agg(F.max(F.struct("ratio", (-F.col("pattern")).alias("k"))).alias("m"))
    on = best.select("lot", (-F.col("m.k")).alias("pattern"), "r", "c", "m.ratio").where(F.col("ratio") >= lo).checkpoint()
    comps = graph.cell_components(on.select("lot", "pattern", "r", "c"), ("lot", "pattern")).join(on, ["lot", "pattern", "r", "c"])
    g = comps.groupBy("lot", "pattern", "comp").agg(F.count(F.lit(1)).alias("cells"), F.max("ratio").alias("top"), F.avg("r").alias("r"), F.avg("c").alias("c"))
    return g.where((F.col("top") >= hi) & (F.col("cells") * cell * cell >= least_cells)).select("lot", "comp", "pattern", "cells", (F.col("r") * cell).alias("r"), (F.col("c") * cell).alias("c"))


def infer_blocks(segs: DataFrame, gap: float = 3.0, window: int = 7, least_rows: int = 8, least_share: float = 0.1, across_gap: float = 2.2, spacing: float | None = None) -> dict[str, DataFrame]:
    """blocks (block, n_rows, n_segs, length, spacing, area) and rows (block, row, v, lo, hi) of line segments seg_id, x1, y1, x2, y2.

    The length-weighted direction gives the frame; the spacing is the median distance to the nearest line beside; lines within
    across_gap spacings and `gap` along belong together, by components of those links; lines of a block are rows while within half a
    spacing of the row's mean; row ends are at least the running median of their neighbours'."""
    graph.shared_dir(segs)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    frame = segs.agg(X.circular_mean(X.line_angle(dx, dy), X.length(dx, dy)).alias("ang"))
    s = segs.join(F.broadcast(frame))
    u = lambda k: X.along(F.col(f"x{k}"), F.col(f"y{k}"), F.col("ang"))
    v = lambda k: X.across(F.col(f"x{k}"), F.col(f"y{k}"), F.col("ang"))
    s = s.select(F.lit(0).alias("g"), "seg_id", F.least(u(1), u(2)).alias("a"), F.greatest(u(1), u(2)).alias("b"), ((v(1) + v(2)) / 2).alias("v")).checkpoint()
    if spacing is None:
        near = J.band_pairs(s, ["g"], "v", 8.0, "seg_id").where("b.v - a.v > 0.3 AND a.a < b.b AND b.a < a.b")
        d = near.groupBy(F.col("a.seg_id").alias("seg_id")).agg(F.min(F.col("b.v") - F.col("a.v")).alias("d"))
        spacing = d.agg(F.percentile("d", F.lit(0.5)).alias("s")).first()["s"] or 1.0
    reach = across_gap * spacing
    beside = J.band_pairs(s.withColumn("v", F.col("v") + F.pmod(F.xxhash64("seg_id"), F.lit(1000)) * 1e-9), ["g"], "v", reach, "seg_id").where((F.col("a.a") <= F.col("b.b") + gap) & (F.col("b.a") <= F.col("a.b") + gap))
    comps = graph.components(beside.select(F.col("a.seg_id").alias("a"), F.col("b.seg_id").alias("b")), s.select(F.col("seg_id").alias("node")))
    m = s.join(comps, s["seg_id"] == comps["node"]).select("comp", "seg_id", "a", "b", "v").checkpoint()
    grouped = ordered.running_groups(m.select("comp", "v").distinct(), ["comp"], "v", 0.5 * spacing)
    m = m.join(grouped, ["comp", "v"])
    rows = m.groupBy("comp", F.col("group").alias("row")).agg(F.avg("v").alias("v"), F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n"), F.sum(F.col("b") - F.col("a")).alias("len"))
    per = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_segs"), F.sum("len").alias("length"))
    top = per.agg(F.max("length").alias("_top"))
    per = per.join(F.broadcast(top)).where((F.col("n_rows") >= least_rows) & (F.col("length") >= least_share * F.col("_top"))).drop("_top")
    rows = rows.join(per.select("comp"), "comp")
    f = Window.partitionBy("comp").orderBy("row").rowsBetween(-(window // 2), window // 2)
    w = Window.partitionBy("comp").orderBy("row")
    rows = rows.select("comp", "row", "v", F.least("a", F.percentile("a", F.lit(0.5)).over(f)).alias("lo"), F.greatest("b", F.percentile("b", F.lit(0.5)).over(f)).alias("hi"), F.coalesce((F.lead("v").over(w) - F.lag("v").over(w)) / 2, F.lead("v").over(w) - F.col("v"), F.col("v") - F.lag("v").over(w)).alias("width"))
    area = rows.groupBy("comp").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("width")).alias("area"), F.first("v").alias("_v"))
    blocks = per.join(area, "comp").withColumn("spacing", F.lit(float(spacing)))
    return {"blocks": blocks.drop("_v").withColumnRenamed("comp", "block"), "rows": rows.withColumnRenamed("comp", "block")}


def analyze_rows(px: DataFrame, est: DataFrame, names: tuple[str, ...] = ("exg", "gli", "ngrdi"), window: int = 12, threshold: float = 0.5) -> dict[str, DataFrame]:
    """profile (lot, name, bin, v, n), choice (lot, name, contrast, width, offset) and windows (lot, row_id, win, z, presence, failing) along known rows.

    Pixels are folded to their distance from the nearest row; the index whose folded profile stands out most, against its standard
    deviation, is taken; the row is as wide as that profile at 60 % of its height."""
    graph.shared_dir(px)
    p = px.where("valid").join(per_lot(est).select("lot", "ang", "per", "v0"), "lot")
    x, y = F.col("c") + 0.5, F.col("r") + 0.5
    t = X.across(x, y, F.col("ang"))
    p = p.select("lot", "per", F.rint((t - F.col("v0")) / F.col("per")).cast("long").alias("row_id"), (t - F.col("v0")).alias("t"), F.floor(X.along(x, y, F.col("ang"))).alias("i"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), X.index(n).alias("v")) for n in names])).alias("x"))
    p = p.select("lot", "per", "row_id", (F.col("t") - F.col("row_id") * F.col("per")).alias("d"), "i", "x.name", "x.v")
    binned = p.groupBy("lot", "name", F.floor(F.col("d") * 2).alias("bin")).agg(F.avg("v").alias("v"), F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    binned = binned.where("n >= 30").checkpoint()
    w3 = Window.partitionBy("lot", "name").orderBy("bin").rangeBetween(-1, 1)
    smooth = binned.select("lot", "name", "bin", F.avg("v").over(w3).alias("v"), "n", "s", "q")
    k = smooth.withColumn("_k", F.row_number().over(Window.partitionBy("lot", "name").orderBy("v"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("lot", "name")))
    stat = k.groupBy("lot", "name").agg(F.avg(F.when(F.col("_k") <= F.greatest(F.lit(3), F.floor(F.col("_n") / 5)), F.col("v"))).alias("base"), F.max("v").alias("peak"), F.max_by("bin", "v").alias("at"), F.sqrt(F.greatest(F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), F.lit(2.0)), F.lit(1e-12))).alias("sd"))
    stat = stat.withColumn("contrast", (F.col("peak") - F.col("base")) / F.col("sd"))
    choice = _best(stat, ["lot"], "contrast", "name").checkpoint()
    wide = Q.width_at(smooth.join(choice.select("lot", "name", "base"), ["lot", "name"]), ["lot"], "bin", "v", "base").select("lot", (F.col("width") / 2).alias("width"))
    choice = choice.join(wide, "lot").select("lot", "name", "contrast", "width", ((F.col("at") + 0.5) / 2).alias("offset"), "base").checkpoint()
    own = p.join(per_lot(choice), ["lot", "name"]).where(F.abs(F.col("d") - F.col("offset")) <= F.col("width") / 2)
    s = own.groupBy("lot", "row_id", "i").agg(F.avg("v").alias("v"), F.first("base").alias("base"))
    ref = s.groupBy("lot").agg(F.percentile("v", F.lit(0.75)).alias("ref"))
    z = s.join(per_lot(ref), "lot").select("lot", "row_id", "i", X.normalised("v", "base", "ref").alias("z"))
    return {"profile": smooth.select("lot", "name", "bin", "v", "n"), "choice": choice, "windows": A.window_means(z, ["lot", "row_id"], "i", "z", window, threshold)}


def stripe_kind(c_level: Column, c_gap: Column, offset: Column, spacing_m: Column, green_share: Column) -> Column:
    """Which stripe is the row (C2, C3): the green one if it is green or a canopy, the dark one if the green lies beside it, the sunlit one
    of a closed canopy of wide rows."""
    return F.when((spacing_m >= 3.5) & (green_share >= 0.3) & (c_level >= 1.1 * c_gap), F.lit("sunlit")).when(c_level > 0.06, F.lit("green")).when((c_level <= 0.0) & (F.abs(offset) > 0.15), F.lit("dark")).otherwise(F.lit("green"))
