"""Queries on scalar expressions and filters (F1-F26, P1-P15) and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import expr as X
from rowloom.operators import aggregate as A
from rowloom.plans.catalog import query
from rowloom.sources import standins as S

_P = "WITH " + S.PIXELS_SQL


def _index(name: str, sql: str):
    """One query per index: F1, F3-F8."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.pixels(spark, sf_dir).where("valid").select("r", "c", F.round(X.index(name), 6).alias("v"))

    query(f"{_P} SELECT r, c, round({sql}, 6) AS v FROM pixel WHERE valid", f"idx_{name}")(run)


_index("exg", "(2 * pg - pr - pb) / (pr + pg + pb + 1e-6)")
_index("vari", "CASE WHEN pg + pr - pb + 1e-6 = 0 THEN NULL ELSE greatest(-1, least(1, (pg - pr) / (pg + pr - pb + 1e-6))) END")
_index("gli", "(2 * pg - pr - pb) / (2 * pg + pr + pb + 1e-6)")
_index("ngrdi", "(pg - pr) / (pg + pr + 1e-6)")
_index("ndvi", "(pn - pr) / (pn + pr + 1e-6)")
_index("dark", "1 - (pr + pg + pb) / 765.0")


@query(_P + " SELECT r, c, round((pr + pg + pb) / 3.0, 6) AS bright, round(2 * pg - pr - pb, 6) AS green FROM pixel")
def brightness(spark, sf_dir):
    return S.pixels(spark, sf_dir).select("r", "c", F.round(X.brightness(), 6).alias("bright"), F.round(X.absolute_green(), 6).alias("green"))


@query(_P + " SELECT valid, count(*) AS n, round(avg((pr + pg + pb) / 3), 6) AS mean_bright FROM pixel GROUP BY valid")
def valid_mask(spark, sf_dir):
    """Pixels by the shadow rule."""
    return S.pixels(spark, sf_dir).groupBy("valid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(X.brightness()), 6).alias("mean_bright"))


@query("WITH " + S.VOTES_SQL + " SELECT id, round(least(d, 180 - d), 6) AS diff FROM (SELECT id, abs(ang - per) % 180.0 AS d FROM vote)")
def angle_diff(spark, sf_dir):
    return S.votes(spark, sf_dir).select("id", F.round(X.angle_diff("ang", "per"), 6).alias("diff"))


@query("WITH " + S.SEGMENTS_SQL + """ SELECT seg_id, round(CASE WHEN a < 0 THEN a + 180 WHEN a >= 180 THEN a - 180 ELSE a END, 6) AS azimuth,
  round(degrees(atan2(dy, dx)), 6) AS angle, round(sqrt(dx * dx + dy * dy), 6) AS len
  FROM (SELECT seg_id, x2 - x1 AS dx, y2 - y1 AS dy, degrees(atan2(x2 - x1, y2 - y1)) AS a FROM seg)""")
def azimuth(spark, sf_dir):
    """F13, F14."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return S.segments(spark, sf_dir).select("seg_id", F.round(X.azimuth(dx, dy), 6).alias("azimuth"), F.round(X.line_angle(dx, dy), 6).alias("angle"), F.round(X.length(dx, dy), 6).alias("len"))


GT = (300000.0, 0.5, 0.0, 6200000.0, 0.0, -0.5)


@query(_P + """ SELECT r, c, x, y, floor((x - 300000.0) / 0.5)::BIGINT AS c2, floor((y - 6200000.0) / -0.5)::BIGINT AS r2
  FROM (SELECT r, c, 300000.0::DOUBLE + (c + 0.5) * 0.5 AS x, 6200000.0::DOUBLE - (r + 0.5) * 0.5 AS y FROM pixel)""")
def affine_map(spark, sf_dir):
    """pixel to map and back."""
    x, y = X.to_map("c", "r", GT)
    p = S.pixels(spark, sf_dir).select("r", "c", x.alias("x"), y.alias("y"))
    c, r = X.to_pixel("x", "y", GT)
    return p.withColumns({"c2": c, "r2": r})


@query(_P + """ SELECT top, CASE WHEN top <= 1.5 THEN 1 / 255.0::DOUBLE WHEN top <= 255 THEN 1.0::DOUBLE ELSE 257.0::DOUBLE END AS scale
  FROM (SELECT round(quantile_cont(greatest(pr, pg, pb), 0.999), 6) AS top FROM pixel WHERE valid)""")
def dn_scale(spark, sf_dir):
    """F24."""
    top = S.pixels(spark, sf_dir).where("valid").withColumn("v", F.greatest("red", "green", "blue"))
    top = A.whole_levels(top, "v", top=0.999).select(F.round("top", 6).alias("top"))
    return top.withColumn("scale", X.dn_scale("top"))


@query(_P + """, g AS (SELECT quantile_cont((2 * pg - pr - pb) / (pr + pg + pb + 1e-6), 0.2) AS base, quantile_cont((2 * pg - pr - pb) / (pr + pg + pb + 1e-6), 0.75) AS ref FROM pixel WHERE valid)
  SELECT r, c, round(CASE WHEN ref - base >= 1e-6 THEN ((2 * pg - pr - pb) / (pr + pg + pb + 1e-6) - base) / (ref - base) END, 6) AS z FROM pixel, g WHERE valid""")
def normalise(spark, sf_dir):
    """F16: 0 at the inter-row level, 1 at the plant level. The levels are one row."""
    p = S.pixels(spark, sf_dir).where("valid").withColumn("v", X.exg())
    levels = A.whole_levels(p, "v", base=0.2, ref=0.75)
    return p.join(F.broadcast(levels)).select("r", "c", F.round(X.normalised("v", "base", "ref"), 6).alias("z"))


@query("WITH " + S.VOTES_SQL + " SELECT id, least(floor(12 * (ring / 7.3 - floor(ring / 7.3))), 11)::BIGINT AS phase, floor((ang - 0) / 2.5)::BIGINT AS bin FROM vote")
def phase_bins(spark, sf_dir):
    """F18, F19."""
    return S.votes(spark, sf_dir).select("id", X.phase_bin("ring", 7.3, 12).cast("long").alias("phase"), X.bin_of("ang", 0, 2.5).alias("bin"))


@query(_P + """ SELECT r, c, round(CASE WHEN abs(den) <= 1e-12 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5 * (a - e) / den)) END, 6) AS off FROM (
  SELECT r, c, a, e, a - 2 * b + e AS den FROM (SELECT r, c, lag(pg) OVER w AS a, pg AS b, lead(pg) OVER w AS e FROM pixel WINDOW w AS (PARTITION BY r ORDER BY c))) WHERE a IS NOT NULL AND e IS NOT NULL""")
def parabola_offset(spark, sf_dir):
    """F20."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("r").orderBy("c")
    p = S.pixels(spark, sf_dir).select("r", "c", F.lag("green").over(w).alias("a"), F.col("green").alias("b"), F.lead("green").over(w).alias("e"))
    return p.where("a IS NOT NULL AND e IS NOT NULL").select("r", "c", F.round(X.parabola_offset("a", "b", "e"), 6).alias("off"))


@query("WITH " + S.VOTES_SQL + """ SELECT src, round(sum(1 / (1 + pow((per - 25) / 12, 2))), 6) AS weight, round(sum(least(pow((per - 25) / 100, 2), 0.0625)), 6) AS loss FROM vote GROUP BY src""")
def robust_loss(spark, sf_dir):
    """F21, F22."""
    res = F.col("per") - 25
    return S.votes(spark, sf_dir).groupBy("src").agg(F.round(F.sum(X.robust_weight(F.lit(1.0), res / 100)), 6).alias("weight"), F.round(X.capped_loss(F.lit(1.0), res / 100), 6).alias("loss"))


@query(_P + """ SELECT r, sum(CASE WHEN con > 20 AND least(b - a, b - e) > 0 THEN 1 ELSE 0 END)::BIGINT AS present FROM (
  SELECT r, a, b, e, b - (a + e) / 2 AS con FROM (SELECT r, lag(pg) OVER w AS a, pg AS b, lead(pg) OVER w AS e FROM pixel WINDOW w AS (PARTITION BY r ORDER BY c))) GROUP BY r""")
def presence(spark, sf_dir):
    """contrast over a threshold with both sides lower."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("r").orderBy("c")
    p = S.pixels(spark, sf_dir).select("r", F.lag("green").over(w).alias("a"), F.col("green").alias("b"), F.lead("green").over(w).alias("e"))
    on = X.present(F.col("b") - (F.col("a") + F.col("e")) / 2, F.col("b") - F.col("a"), F.col("b") - F.col("e"), 20.0)
    return p.groupBy("r").agg(F.sum(on.cast("long")).alias("present"))


@query("""SELECT n_name AS lot, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS review FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def review_reasons(spark, sf_dir):
    """The flags of each lot in one string."""
    c = S.read(spark, sf_dir, "customer").join(F.broadcast(S.read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("lot")).agg(X.reasons("c_mktsegment").alias("review"))


@query("SELECT p_partkey AS id, round_even(p_retailprice / 8, 1) AS half_even FROM part")
def rounding(spark, sf_dir):
    """F26."""
    return S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.half_even(F.col("p_retailprice") / 8, 1).alias("half_even"))


@query(_P + """ SELECT (r // 8)::BIGINT AS wr, (c // 7)::BIGINT AS wc, round(avg(valid::INT), 6) AS frac FROM pixel GROUP BY ALL HAVING avg(valid::INT) >= 0.7""")
def window_valid(spark, sf_dir):
    """Windows with enough valid pixels."""
    p = S.pixels(spark, sf_dir).groupBy(F.floor(F.col("r") / 8).alias("wr"), F.floor(F.col("c") / 7).alias("wc")).agg(F.avg(F.col("valid").cast("int")).alias("f"))
    return p.where("f >= 0.7").select("wr", "wc", F.round("f", 6).alias("frac"))


@query(_P + """ SELECT (r // 4)::BIGINT AS r2, (c // 3)::BIGINT AS c2, round(avg(pr), 6) AS red, round(avg(pg), 6) AS green, avg(valid::INT) > 0.999 AS valid
  FROM pixel WHERE c < 21 AND r < 4 * ((SELECT max(r) + 1 FROM pixel) // 4) GROUP BY ALL""")
def downsample_avg(spark, sf_dir):
    """Cells of 4 x 3 pixels; what is left over at the end is cut off."""
    p = S.pixels(spark, sf_dir)
    rows = p.agg((F.floor((F.max("r") + 1) / 4) * 4).alias("rows"))
    p = p.join(F.broadcast(rows)).where("r < rows")
    return p.groupBy(F.floor(F.col("r") / 4).alias("r2"), F.floor(F.col("c") / 3).alias("c2")).agg(F.round(F.avg("red"), 6).alias("red"), F.round(F.avg("green"), 6).alias("green"), (F.avg(F.col("valid").cast("int")) > 0.999).alias("valid"))


@query(_P + " SELECT r, c, round(pg, 6) AS green FROM pixel WHERE r BETWEEN 97 AND 143 AND c BETWEEN 4 AND 12")
def windowed_scan(spark, sf_dir):
    """A box of the raster with its margin; the row filter reaches the Parquet scan."""
    return S.pixels(spark, sf_dir).where("r BETWEEN 97 AND 143 AND c BETWEEN 4 AND 12").select("r", "c", F.round("green", 6).alias("green"))


@query(_P + ", g AS (SELECT quantile_cont((2 * pg - pr - pb) / (pr + pg + pb + 1e-6), 0.995) - quantile_cont((2 * pg - pr - pb) / (pr + pg + pb + 1e-6), 0.005) AS spread, count(*) AS n FROM pixel WHERE valid) SELECT round(spread, 6) AS spread, n, spread >= 1e-6 AND n > 0 AS usable FROM g")
def source_guard(spark, sf_dir):
    """Is there anything to see."""
    v = S.pixels(spark, sf_dir).where("valid").withColumn("v", X.exg())
    p = A.whole_levels(v, "v", hi=0.995, lo=0.005).select((F.col("hi") - F.col("lo")).alias("s")).join(F.broadcast(v.agg(F.count(F.lit(1)).alias("n"))))
    return p.select(F.round("s", 6).alias("spread"), "n", ((F.col("s") >= 1e-6) & (F.col("n") > 0)).alias("usable"))


@query(_P + """, k AS (SELECT k, CASE k WHEN 0 THEN 1 / 255.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 257.0::DOUBLE END AS f FROM range(0, 3) AS t(k)),
  s AS (SELECT k, r, c, pr * f AS r1, pg * f AS g1, pb * f AS b1 FROM pixel, k), t AS (SELECT k, quantile_cont(greatest(r1, g1, b1), 0.999) AS top FROM s GROUP BY k)
  SELECT k::INT AS k, count(*) FILTER ((r1 + g1 + b1) / 3 >= 30 * (CASE WHEN top <= 1.5 THEN 1 / 255.0::DOUBLE WHEN top <= 255 THEN 1.0::DOUBLE ELSE 257.0::DOUBLE END) + 1e-9) AS bright, count(*) AS n FROM s JOIN t USING (k) GROUP BY k""")
def shadow_scale(spark, sf_dir):
    """Pixels over the shadow threshold, as reflectances, in 8 and in 16 bits: the threshold goes with the scale of the numbers."""
    p = S.pixels(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[(F.col(c) * f).alias(c) for c in ("red", "green", "blue")]) for k, f in enumerate((1 / 255.0, 1.0, 257.0))])).alias("x")).select("x.*")
    top = p.groupBy("k").agg(F.percentile(F.greatest("red", "green", "blue"), F.lit(0.999)).alias("top")).select("k", X.dn_scale("top").alias("scale"))
    on = X.brightness() >= X.SHADOW * F.col("scale") + 1e-9
    return p.join(F.broadcast(top), "k").groupBy("k").agg(F.count(F.when(on, 1)).alias("bright"), F.count(F.lit(1)).alias("n"))
