"""Further queries: stripes (G4-G6), rings (N7-N9), propagation (I6, I9, I13), conflicts (I18), row statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.operators import geometry as G
from rowloom.operators import graph
from rowloom.operators import sequence as Q
from rowloom.plans.catalog import query
from rowloom.sources import standins as S
from rowloom.sources import vectors

_P, _S = f"WITH {S.PIXELS_SQL}", f"WITH {S.SERIES_SQL}"


def _r(c, alias=None):
    return F.round(c, 6).alias(alias or c)


_PROF = """b AS (SELECT r // 25 AS blk, c, avg(pg) AS g, avg(pr) AS d, count(*) AS n FROM pixel WHERE valid GROUP BY ALL), m AS (SELECT blk, median(n) AS mn FROM b GROUP BY blk), p AS (SELECT b.* FROM b JOIN m USING (blk) WHERE n >= 0.2 * mn)"""


def _profiles(spark, sf_dir):
    p = S.pixels(spark, sf_dir).where("valid").groupBy(F.floor(F.col("r") / 25).alias("blk"), "c").agg(F.avg("green").alias("g"), F.avg("red").alias("d"), F.count(F.lit(1)).alias("n"))
    m = p.groupBy("blk").agg(F.percentile("n", F.lit(0.5)).alias("mn"))
    return p.join(m, "blk").where(F.col("n") >= 0.2 * F.col("mn"))


@query(f"{_P}, {_PROF} SELECT blk::BIGINT AS blk, c, round(g, 6) AS g, round(d, 6) AS d FROM p")
def stripe_profiles(spark, sf_dir):
    """Profiles of several images in one pass; thin bins are left out."""
    return _profiles(spark, sf_dir).select("blk", "c", _r("g"), _r("d"))


_TOPS = """k AS (SELECT *, g >= max(g) OVER (PARTITION BY blk ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AND (lag(g) OVER (PARTITION BY blk ORDER BY c) IS NULL OR g > lag(g) OVER (PARTITION BY blk ORDER BY c)) AS top FROM p),
  t AS (SELECT blk, c, g, lead(c) OVER (PARTITION BY blk ORDER BY c) AS nc FROM k WHERE top), mid AS (SELECT t.blk, p.g FROM t JOIN p ON p.blk = t.blk AND p.c = (t.c + t.nc) // 2 WHERE nc - t.c BETWEEN 3 AND 6)"""


@query(f"{_P}, {_PROF}, {_TOPS} SELECT blk::BIGINT AS blk, round(hi, 6) AS hi, round(lo, 6) AS lo FROM (SELECT blk, median(g) AS hi FROM t GROUP BY blk HAVING count(*) >= 3) JOIN (SELECT blk, median(g) AS lo FROM mid GROUP BY blk HAVING count(*) >= 2) USING (blk)")
def stripe_levels(spark, sf_dir):
    """Medians at the peaks of a profile and half-way between near ones."""
    p = _profiles(spark, sf_dir).select("blk", "c", "g")
    t = p.withColumn("top", Q.local_maximum("g", ["blk"], "c", 2)).where("top").select("blk", "c", "g", F.lead("c").over(Window.partitionBy("blk").orderBy("c")).alias("nc"))
    hi = t.groupBy("blk").agg(F.percentile("g", F.lit(0.5)).alias("hi"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    mid = t.where((F.col("nc") - F.col("c")).between(3, 6)).select("blk", F.floor((F.col("c") + F.col("nc")) / 2).cast("int").alias("c")).join(p, ["blk", "c"])
    lo = mid.groupBy("blk").agg(F.percentile("g", F.lit(0.5)).alias("lo"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    return hi.join(lo, "blk").select("blk", _r("hi"), _r("lo"))


@query(f"""{_P}, {_PROF}, {_TOPS}, o AS (SELECT t.blk, t.c, p.c - t.c AS off FROM t JOIN p ON p.blk = t.blk AND abs(p.c - t.c) <= 3 QUALIFY row_number() OVER (PARTITION BY t.blk, t.c ORDER BY round(p.d, 9), p.c) = 1)
  SELECT blk::BIGINT AS blk, median(off) AS off FROM o GROUP BY blk""")
def stripe_offset(spark, sf_dir):
    """How far from a profile's peaks the other image's minimum lies."""
    p = _profiles(spark, sf_dir).select("blk", "c", "g", "d")
    t = p.withColumn("top", Q.local_maximum("g", ["blk"], "c", 2)).where("top").select("blk", F.col("c").alias("tc"), F.explode(F.array(*[F.lit(k) for k in range(-3, 4)])).alias("off")).withColumn("c", F.col("tc") + F.col("off"))
    m = t.join(p.select("blk", "c", "d"), ["blk", "c"]).groupBy("blk", "tc").agg(F.min(F.struct(F.round("d", 9).alias("d"), "off")).alias("m"))
    return m.groupBy("blk").agg(F.percentile("m.off", F.lit(0.5)).alias("off"))


@query("SELECT * FROM (VALUES (0, 24.0::DOUBLE, 4), (1, 20.0::DOUBLE, 6)) AS t(comp, area, corners)")
def component_rings(spark, sf_dir):
    """Outer rings of two known components: a 6 x 4 block, and an L of 20 cells."""
    c = spark.range(6).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("c"), F.lit(0).alias("comp"))
    ell = spark.range(8).select((F.col("id") + 10).alias("r"), F.explode(F.when(F.col("id") < 6, F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).alias("c"), F.lit(1).alias("comp"))
    return G.component_rings(c.unionByName(ell), ["comp"], 0.25).select("comp", "area", F.size("ring").alias("corners"))


@query(f"WITH {S.SEGMENTS_SQL} SELECT seg_id, round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) * 3.0, 4) AS area FROM seg WHERE x1 <> x2 OR y1 <> y2")
def line_buffers(spark, sf_dir):
    """Lines as rectangles; the shoelace area is length times width."""
    s = S.segments(spark, sf_dir).where("x1 != x2 OR y1 != y2").withColumn("ring", G.line_buffer("x1", "y1", "x2", "y2", 1.5))
    return s.select("seg_id", F.round(F.abs(vectors.signed_area("ring")), 4).alias("area"))


@query("""WITH x AS (SELECT s_nationkey AS lot, s_acctbal AS v, s_suppkey % 7 * 10.0::DOUBLE AS lo, s_suppkey % 7 * 10.0::DOUBLE + 50 + s_suppkey % 3 AS hi FROM supplier),
  e AS (SELECT lot, lo, hi, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM x WINDOW w AS (PARTITION BY lot ORDER BY v)), s AS (SELECT *, coalesce(q - v, v - p, 0) AS near FROM e)
  SELECT lot, round(sum((hi - lo) * (coalesce((v + q) / 2, v + near / 2) - coalesce((v + p) / 2, v - near / 2))), 3) AS area FROM s GROUP BY lot""")
def stepped_rings(spark, sf_dir):
    """The ring of a block from its rows' strips; its area is that of the strips."""
    x = S.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("lot"), F.col("s_acctbal").alias("v"), (F.col("s_suppkey") % 7 * 10.0).alias("lo"), (F.col("s_suppkey") % 7 * 10.0 + 50 + F.col("s_suppkey") % 3).alias("hi"))
    return G.stepped_ring(x, ["lot"]).select("lot", F.round(F.abs(vectors.signed_area("ring")), 3).alias("area"))


@query("""WITH x AS (SELECT s_nationkey AS lot, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS slope FROM supplier)
  SELECT lot, k::INT AS k, round(coalesce(slope, last_value(slope IGNORE NULLS) OVER (PARTITION BY lot ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(slope IGNORE NULLS) OVER (PARTITION BY lot ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS slope FROM x""")
def slope_propagation(spark, sf_dir):
    """Rows without a slope of their own take that of the last row before them that has one, else of the next."""
    w = Window.partitionBy("lot").orderBy("k")
    x = S.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("lot"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("k"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal")).alias("s"))
    s = F.coalesce("s", F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return x.select("lot", "k", _r(s, "slope"))


@query(f"""{_P}, p AS (SELECT r // 25 AS blk, c, round(avg(pg), 9) AS v FROM pixel GROUP BY ALL)
  SELECT blk::BIGINT AS blk, (k * 5)::INT AS centre, (c - k * 5)::INT AS moved FROM p, range(1, 4) AS t(k) WHERE abs(c - k * 5) <= 2 QUALIFY row_number() OVER (PARTITION BY blk, k ORDER BY v DESC, abs(c - k * 5), c) = 1""")
def relocate_centres(spark, sf_dir):
    """Each centre moves to the brightest place near it, the nearer of equals."""
    p = S.pixels(spark, sf_dir).groupBy(F.floor(F.col("r") / 25).alias("blk"), "c").agg(F.avg("green").alias("v"))
    x = p.withColumn("centre", F.explode(F.array(*[F.lit(5 * k) for k in (1, 2, 3)]))).where(F.abs(F.col("c") - F.col("centre")) <= 2)
    best = x.groupBy("blk", "centre").agg(F.min(F.struct((-F.round("v", 9)).alias("v"), F.abs(F.col("c") - F.col("centre")).alias("d"), "c")).alias("m"))
    return best.select("blk", "centre", (F.col("m.c") - F.col("centre")).alias("moved"))


@query(f"""{_S}, lv AS (SELECT row_id, quantile_cont(v, 0.5) AS own FROM series GROUP BY row_id), nb AS (SELECT a.row_id, any_value(a.own) AS own, avg(b.own) AS near, count(b.own) AS n FROM lv a LEFT JOIN lv b ON b.row_id IN (a.row_id - 1, a.row_id + 1) GROUP BY a.row_id)
  SELECT row_id, CASE WHEN n < 2 THEN 'alone' WHEN own < 0.8 * near THEN 'low' WHEN own > 1.25 * near THEN 'high' ELSE 'same' END AS verdict FROM nb""")
def level_rescue(spark, sf_dir):
    """A row's level against that of its two neighbours by number."""
    lv = S.series(spark, sf_dir).groupBy("row_id").agg(F.percentile("v", F.lit(0.5)).alias("own"))
    near = lv.select(F.explode(F.array(F.col("row_id") - 1, F.col("row_id") + 1)).alias("row_id"), F.col("own").alias("o")).groupBy("row_id").agg(F.avg("o").alias("near"), F.count("o").alias("n"))
    x = lv.join(near, "row_id", "left")
    v = F.when(F.coalesce("n", F.lit(0)) < 2, "alone").when(F.col("own") < 0.8 * F.col("near"), "low").when(F.col("own") > 1.25 * F.col("near"), "high").otherwise("same")
    return x.select("row_id", v.alias("verdict"))


@query("SELECT s_suppkey AS node, CASE WHEN s_suppkey = 0 THEN 0 ELSE ((s_suppkey - 1) // 5) * 5 + 1 END AS comp FROM supplier")
def chain_components(spark, sf_dir):
    """Components of links between numbered rows: fives."""
    s = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    links = s.where("node % 5 != 0").select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")).join(s.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    return graph.components(links, s)
