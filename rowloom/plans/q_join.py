"""Queries on joins, sets, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.functions import expr as X
from rowloom.operators import graph
from rowloom.operators import joins as J
from rowloom.operators import sequence as Q
from rowloom.plans.catalog import query
from rowloom.sources import standins as S

_P, _S, _V, _G, _I = (f"WITH {x}" for x in (S.PIXELS_SQL, S.SERIES_SQL, S.VOTES_SQL, S.SEGMENTS_SQL, S.INTERVALS_SQL))


def _r(c, alias=None):
    return F.round(c, 6).alias(alias or c)


def lots(spark, sf_dir):
    """lot, j, x, y: a ring of six corners per nation."""
    n = S.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("lot"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
    rad = 5 + (F.col("lot") * 3 + F.col("j") * 7) % 5
    a = F.radians(60.0 * F.col("j") + 3)
    return n.select("lot", "j", (10 + rad * F.cos(a)).alias("x"), (20.0 * F.col("lot") + 10 + rad * F.sin(a)).alias("y"))


_LOTS = """corner AS (SELECT n_nationkey AS lot, j, 10 + (5 + (n_nationkey * 3 + j * 7) % 5) * cos(radians(60.0 * j + 3)) AS x,
    20.0::DOUBLE * n_nationkey + 10 + (5 + (n_nationkey * 3 + j * 7) % 5) * sin(radians(60.0 * j + 3)) AS y FROM nation, range(0, 6) AS t(j)),
  edge AS (SELECT a.lot, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corner a JOIN corner b ON a.lot = b.lot AND b.j = (a.j + 1) % 6)"""


@query(f"""{_P}, pt AS (SELECT s_suppkey AS id, 0.21 * s_suppkey % 23 AS x, s_acctbal / 20.0 AS y FROM supplier)
  SELECT id, round(pg, 6) AS v, pg IS NOT NULL AS ok FROM pt LEFT JOIN pixel ON c = floor(x) AND r = floor(y)""")
def nearest_sample(spark, sf_dir):
    """Points take the value of their pixel; outside there is none."""
    p = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(F.pmod(0.21 * F.col("s_suppkey"), F.lit(23.0))).alias("c"), F.floor(F.col("s_acctbal") / 20.0).alias("r"))
    return p.join(S.pixels(spark, sf_dir).select("r", "c", "green"), ["r", "c"], "left").select("id", _r("green", "v"), F.col("green").isNotNull().alias("ok"))


@query(f"""{_P}, g AS (SELECT id, k, x, y FROM (SELECT a * 100 + b AS id, 30 + a * cos(radians(20)) - b * sin(radians(20)) AS y, 3 + a * sin(radians(20)) + b * cos(radians(20)) AS x FROM range(0, 40) AS t(a), range(0, 8) AS s(b)), range(0, 4) AS q(k)),
  w AS (SELECT id, floor(y)::BIGINT + k // 2 AS r, floor(x)::BIGINT + k % 2 AS c, (CASE WHEN k // 2 = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN k % 2 = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM g)
  SELECT id::INT AS id, round(sum(w * coalesce(pg, 0)), 6) AS v FROM w LEFT JOIN pixel USING (r, c) GROUP BY id""")
def rotated_resample(spark, sf_dir):
    """A turned grid, each point from its four pixels; beyond the border is 0."""
    import math

    s, c = math.sin(math.radians(20)), math.cos(math.radians(20))
    g = spark.range(40).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    g = g.select((F.col("a") * 100 + F.col("b")).alias("id"), (30 + F.col("a") * c - F.col("b") * s).alias("y"), (3 + F.col("a") * s + F.col("b") * c).alias("x"))
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    taps = F.array(*[F.struct((F.floor("y") + i).alias("r"), (F.floor("x") + j).alias("c"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i in (0, 1) for j in (0, 1)])
    w = g.select("id", F.explode(taps).alias("t")).select("id", "t.r", "t.c", "t.w")
    p = S.pixels(spark, sf_dir).select("r", F.col("c").cast("long").alias("c"), "green")
    return w.join(p, ["r", "c"], "left").groupBy("id").agg(_r(F.sum(F.col("w") * F.coalesce("green", F.lit(0.0))), "v"))


@query("""WITH m AS (SELECT s_nationkey AS lot, s_suppkey AS near, s_acctbal AS p FROM supplier), c AS (SELECT c_custkey AS id, c_nationkey AS lot, c_acctbal AS v FROM customer)
  SELECT id, near::VARCHAR AS near, round(v - p, 6) AS dist FROM c LEFT JOIN m USING (lot) QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(v - p), p) = 1""")
def asof_nearest_fold(spark, sf_dir):
    """The nearest row on either side, and the signed distance to it."""
    m = S.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("lot"), F.col("s_suppkey").alias("sid"), "s_acctbal")
    c = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("lot"), F.col("c_acctbal").alias("v"))
    return J.asof_nearest(c, m, ["lot"], "v", "s_acctbal", "sid").select("id", "near", _r("dist"))


@query(f"""{_G}, p AS (SELECT a.lot_id, a.seg_id, min(b.x1 - a.x1) AS d FROM seg a JOIN seg b ON a.lot_id = b.lot_id AND b.x1 - a.x1 > 0.3 AND b.x1 - a.x1 <= 8 AND a.y1 < b.y2 AND b.y1 < a.y2 AND a.seg_id <> b.seg_id GROUP BY a.lot_id, a.seg_id)
  SELECT lot_id, round(median(d), 6) AS spacing, count(*) AS n FROM p GROUP BY lot_id""")
def spacing_self_join(spark, sf_dir):
    """The nearest neighbour of each segment within 8 units that runs beside it; the median per lot."""
    s = S.segments(spark, sf_dir)
    graph.shared_dir(s)
    d = J.nearest_beside(s.checkpoint(), ["lot_id"], "x1", 0.3, 8.0, "seg_id", "y1", "y2")
    return d.groupBy("lot_id").agg(_r(F.percentile("d", F.lit(0.5)), "spacing"), F.count(F.lit(1)).alias("n"))


_PIECES = "piece AS (SELECT s_suppkey AS row_id, k AS piece, 200.0::DOUBLE * k + s_suppkey AS c, 200.0::DOUBLE * k + s_suppkey + 90 AS d FROM supplier, range(0, 13) AS t(k))"


def _pieces(spark, sf_dir):
    s = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("piece"))
    return s.select("row_id", F.col("piece").cast("long").alias("piece"), (200.0 * F.col("piece") + F.col("row_id")).alias("c"), (200.0 * F.col("piece") + F.col("row_id") + 90).alias("d"))


@query(f"{_I}, {_PIECES} SELECT row_id, piece, count(*) AS n, round(sum(least(b, d) - greatest(a, c)), 4) AS inside FROM iv JOIN piece USING (row_id) WHERE least(b, d) > greatest(a, c) GROUP BY ALL")
def interval_clip(spark, sf_dir):
    """Intervals clipped by the pieces of a contour."""
    o = J.interval_overlap(S.intervals(spark, sf_dir), _pieces(spark, sf_dir), ["row_id"], 50.0)
    return o.groupBy("row_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("hi") - F.col("lo")), 4).alias("inside"))


_UNION = """u AS (SELECT row_id, a, b FROM iv UNION ALL SELECT row_id, c AS a, d AS b FROM piece),
  m AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY row_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS new FROM u))"""


@query(f"{_I}, {_PIECES}, {_UNION} SELECT row_id, a, round(max_b, 6) AS b, n FROM (SELECT row_id, min(a) AS a, max(b) AS max_b, count(*) AS n FROM m GROUP BY row_id, run)")
def interval_union(spark, sf_dir):
    """All intervals with all pieces; n of them are in each."""
    more = _pieces(spark, sf_dir).select("row_id", F.col("c").alias("a"), F.col("d").alias("b"))
    return Q.merge_intervals(S.intervals(spark, sf_dir).unionByName(more), ["row_id"]).select("row_id", "a", _r("b"), "n")


@query(f"{_I}, {_PIECES}, m AS (SELECT row_id, a, b, piece, c, d FROM iv LEFT JOIN piece ON piece.row_id = iv.row_id AND c > a AND d < b + 90 AND c < b) SELECT m.row_id, count(*) AS n, round(sum(CASE WHEN c IS NULL THEN b - a ELSE c - a END), 4) AS kept FROM m GROUP BY ALL".replace("SELECT row_id, a, b, piece, c, d", "SELECT iv.row_id, a, b, piece, c, d"))
def interval_diff(spark, sf_dir):
    """What is left of intervals before the piece that cuts them begins."""
    iv = S.intervals(spark, sf_dir).withColumn("id", F.monotonically_increasing_id())
    o = J.interval_overlap(iv, _pieces(spark, sf_dir), ["row_id"], 50.0).where("c > a AND d < b + 90 AND c < b").select("id", F.col("c").alias("cut"))
    return iv.join(o, "id", "left").groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("cut", "b") - F.col("a")), 4).alias("kept"))


@query(f"""WITH {_LOTS}, line AS (SELECT k, k * 1.5::DOUBLE AS y FROM range(0, 334) AS t(k)), x AS (SELECT lot, k, x1 + (y - y1) * (x2 - x1) / (y2 - y1) AS x FROM edge JOIN line ON (y1 <= y AND y < y2) OR (y2 <= y AND y < y1)),
  n AS (SELECT lot, k, x, row_number() OVER (PARTITION BY lot, k ORDER BY x) AS n, lead(x) OVER (PARTITION BY lot, k ORDER BY x) AS xe FROM x) SELECT lot, k, round(x, 6) AS x1, round(xe, 6) AS x2 FROM n WHERE n % 2 = 1 AND xe IS NOT NULL""")
def line_polygon_clip(spark, sf_dir):
    """The pieces of parallel lines inside rings."""
    return J.scanlines(J.edges(lots(spark, sf_dir), ["lot"], "j"), ["lot"], 1.5).select("lot", "k", _r("x1"), _r("x2"))


_INSIDE = f"""{_LOTS}, cell AS (SELECT r, c FROM range(0, 500) AS t(r), range(0, 21) AS s(c)), inside AS (
  SELECT lot, r, c FROM cell JOIN edge ON ((y1 <= r AND r < y2) OR (y2 <= r AND r < y1)) AND x1 + (r - y1) * (x2 - x1) / (y2 - y1) > c GROUP BY lot, r, c HAVING count(*) % 2 = 1)"""


@query(f"WITH {_INSIDE} SELECT lot, count(*) AS cells, sum(r)::BIGINT AS sr, sum(c)::BIGINT AS sc FROM inside GROUP BY lot")
def points_in_polygon(spark, sf_dir):
    """The pixels in each ring, by scanlines."""
    cells = J.cells_inside(J.scanlines(J.edges(lots(spark, sf_dir), ["lot"], "j"), ["lot"]), ["lot"]).where("r BETWEEN 0 AND 499 AND c BETWEEN 0 AND 20")
    return cells.groupBy("lot").agg(F.count(F.lit(1)).alias("cells"), F.sum("r").alias("sr"), F.sum("c").alias("sc"))


@query(f"""WITH {_INSIDE}, q AS (SELECT lot, r, c, unnest([{{'n': 'n', 'r': -1, 'c': 0}}, {{'n': 's', 'r': 1, 'c': 0}}, {{'n': 'w', 'r': 0, 'c': -1}}, {{'n': 'e', 'r': 0, 'c': 1}}]) AS s FROM inside)
  SELECT q.lot, s.n AS side, count(*) AS n FROM q LEFT JOIN inside i ON i.lot = q.lot AND i.r = q.r + s.r AND i.c = q.c + s.c WHERE i.lot IS NULL GROUP BY ALL""")
def mask_outline(spark, sf_dir):
    """The sides of a mask's cells that lie on its border."""
    cells = J.cells_inside(J.scanlines(J.edges(lots(spark, sf_dir), ["lot"], "j"), ["lot"]), ["lot"]).where("r BETWEEN 0 AND 499 AND c BETWEEN 0 AND 20")
    return J.outline(cells, ["lot"]).groupBy("lot", "side").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_INSIDE}, s AS (SELECT DISTINCT lot, r + k AS r, c FROM inside, range(-2, 3) AS t(k)) SELECT lot, count(*) AS cells FROM s GROUP BY lot""")
def polygon_sweep(spark, sf_dir):
    """A mask swept across the rows, as the union of shifted copies."""
    cells = J.cells_inside(J.scanlines(J.edges(lots(spark, sf_dir), ["lot"], "j"), ["lot"]), ["lot"]).where("r BETWEEN 0 AND 499 AND c BETWEEN 0 AND 20")
    return cells.select("lot", F.explode(F.array(*[F.col("r") + k for k in (-2, -1, 0, 1, 2)])).alias("r"), "c").distinct().groupBy("lot").agg(F.count(F.lit(1)).alias("cells"))


@query(f"{_S} SELECT a.row_id, a.i, round((b.v + c.v) / 2, 6) AS filled FROM series a JOIN series b ON b.row_id = a.row_id - 1 AND b.i = a.i JOIN series c ON c.row_id = a.row_id + 1 AND c.i = a.i WHERE a.v IS NULL AND b.v IS NOT NULL AND c.v IS NOT NULL")
def neighbour_fill(spark, sf_dir):
    """Unknown places between two known neighbours by row number (rows may be missing, so it is a join and no lag)."""
    s = S.series(spark, sf_dir)
    known = s.where("v IS NOT NULL")
    gaps = s.where("v IS NULL").select("row_id", "i")
    for name, k in (("p", 1), ("q", -1)):
        gaps = gaps.join(known.select((F.col("row_id") + k).alias("row_id"), "i", F.col("v").alias(name)), ["row_id", "i"])
    return gaps.select("row_id", "i", _r((F.col("p") + F.col("q")) / 2, "filled"))


@query("SELECT c_custkey AS id FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s WHERE s_nationkey = c_nationkey AND abs(abs(c_acctbal - s_acctbal) / 500 - round_even(abs(c_acctbal - s_acctbal) / 500, 0)) <= 0.02 AND round_even(abs(c_acctbal - s_acctbal) / 500, 0) >= 1)")
def lattice_semijoin(spark, sf_dir):
    """Rows at a whole number of spacings from a row of the same lot."""
    s = S.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("lot"), F.col("s_acctbal").alias("p"))
    c = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("lot"), F.col("c_acctbal").alias("v"))
    return J.lattice_members(c, s, ["lot"], "v", "p", 500.0, 0.02).select("id")


@query(f"{_V} SELECT src, count(*) AS n, round(sum(ring), 4) AS ring FROM vote GROUP BY src UNION ALL SELECT 'all', count(*), round(sum(ring), 4) FROM vote")
def votes_union(spark, sf_dir):
    """U1."""
    v = S.votes(spark, sf_dir)
    agg = [F.count(F.lit(1)).alias("n"), F.round(F.sum("ring"), 4).alias("ring")]
    return v.groupBy("src").agg(*agg).unionByName(v.groupBy(F.lit("all").alias("src")).agg(*agg))


@query(f"""{_P}, s AS (SELECT r, c, k, abs(pg - k * 40) AS d FROM pixel, range(0, 7) AS t(k)) SELECT r, c, k::INT AS k FROM s QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY d, k) = 1""")
def candidate_argmax(spark, sf_dir):
    """The best of some patterns for each pixel, the first of equals; an array of candidates and no shuffle."""
    p = S.pixels(spark, sf_dir)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col("green") - 40 * k).alias("d"), F.lit(k).alias("k")) for k in range(7)]))
    return p.select("r", "c", best["k"].alias("k"))


@query("SELECT n_nationkey AS lot, row_number() OVER (ORDER BY round_even((n_nationkey * 37 % 101) / 50.0, 0), n_nationkey * 53 % 89, n_nationkey)::INT AS k FROM nation")
def north_south_order(spark, sf_dir):
    """T4: lots numbered in strips of 50 from north to south, then from west to east (as many rows as lots)."""
    n = S.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("lot"))
    w = Window.orderBy(F.bround((F.col("lot") * 37 % 101) / 50.0), F.col("lot") * 53 % 89, "lot")
    return n.select("lot", F.row_number().over(w).alias("k"))


@query(f"{_G} SELECT seg_id, round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) AS len FROM seg ORDER BY round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) DESC, seg_id LIMIT 40")
def topk_longest(spark, sf_dir):
    """The 40 longest, as the report asks for."""
    s = S.segments(spark, sf_dir).select("seg_id", F.round(X.length(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 6).alias("len"))
    return s.orderBy(F.desc("len"), "seg_id").limit(40)


@query(f"""{_G}, t AS (SELECT seg_id, row_number() OVER (ORDER BY round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) DESC, seg_id) - 1 AS k FROM seg ORDER BY k LIMIT 40)
  SELECT seg_id, k::INT AS k FROM t WHERE k IN (0, 10, 20, 29, 39)""")
def even_sample(spark, sf_dir):
    """Five of the 40 longest, evenly spaced. The limit comes first, so the numbering sees 40 rows."""
    top = topk_longest(spark, sf_dir).withColumn("k", F.row_number().over(Window.orderBy(F.desc("len"), "seg_id")) - 1)
    return top.where(F.col("k").isin(0, 10, 20, 29, 39)).select("seg_id", "k")


@query(f"{_V} SELECT src, id, per FROM vote QUALIFY row_number() OVER (PARTITION BY src ORDER BY per DESC, id) = 1")
def argmax_tiebreak(spark, sf_dir):
    """The first of the greatest, by an aggregate of one struct."""
    v = S.votes(spark, sf_dir)
    top = v.groupBy("src").agg(F.max(F.struct("per", (-F.col("id")).alias("k"))).alias("m"))
    return top.select("src", (-F.col("m.k")).alias("id"), "m.per")


@query("SELECT o_orderpriority AS lot, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END NULLS LAST, o_totalprice DESC, o_orderkey)::INT AS k FROM orders QUALIFY k <= 3")
def groups_none_last(spark, sf_dir):
    """By a key whose nulls come last, then by size; three of each group."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).asc_nulls_last(), F.desc("o_totalprice"), "o_orderkey")
    o = S.read(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3")
    return o.select(F.col("o_orderpriority").alias("lot"), F.col("o_orderkey").alias("id"), "k")
