"""Queries on ordered series (W1-W23) and the flagship, row_failures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.functions import expr as X
from rowloom.operators import aggregate as A
from rowloom.operators import sequence as Q
from rowloom.plans.catalog import query
from rowloom.sources import standins as S

_P, _S, _I = (f"WITH {x}" for x in (S.PIXELS_SQL, S.SERIES_SQL, S.INTERVALS_SQL))
BY = ["row_id"]


def _r(c, alias=None):
    return F.round(c, 6).alias(alias or c)


@query(f"{_S} SELECT row_id, i, round(avg(v) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS m FROM series")
def box_smooth(spark, sf_dir):
    """The mean of the known values in a frame."""
    return S.series(spark, sf_dir).select("row_id", "i", _r(Q.box_mean(F.col("v"), Q.ordered(BY, "i"), 2, 2), "m"))


_GW = Q.gaussian_weights(1.0)
_GSQL = " + ".join(
    f"{g!r}::DOUBLE * " + ("pg" if k == 0 else f"coalesce({'lag' if k < 0 else 'lead'}(pg, {abs(k)}) OVER w, {'first' if k < 0 else 'last'}_value(pg) OVER f)") for k, g in zip(range(-(len(_GW) // 2), len(_GW) // 2 + 1), _GW)
)


@query(f"{_P} SELECT r, c, round({_GSQL}, 6) AS v FROM pixel WINDOW w AS (PARTITION BY r ORDER BY c), f AS (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def gauss_smooth(spark, sf_dir):
    """With the ends continued."""
    return S.pixels(spark, sf_dir).select("r", "c", F.round(Q.gaussian("green", ["r"], "c", 1.0), 6).alias("v"))


@query(f"{_S} SELECT row_id, i, round(CASE WHEN count(v) OVER f * 2 >= 7 THEN quantile_cont(v, 0.5) OVER f END, 6) AS m FROM series WINDOW f AS (PARTITION BY row_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def moving_median(spark, sf_dir):
    """W4."""
    return S.series(spark, sf_dir).select("row_id", "i", _r(Q.moving_median("v", BY, "i", 3), "m"))


_PEAK = """pk AS (SELECT r, c, pg, pg >= max(pg) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AND (lag(pg) OVER w IS NULL OR pg > lag(pg) OVER w) AS top,
  pg - greatest(min(pg) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), min(pg) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) AS prom
  FROM pixel WINDOW w AS (PARTITION BY r ORDER BY c))"""


@query(f"{_P}, {_PEAK} SELECT r, c, round(pg, 6) AS v FROM pk WHERE top")
def local_maxima(spark, sf_dir):
    """W5."""
    p = S.pixels(spark, sf_dir).select("r", "c", "green")
    return p.withColumn("top", Q.local_maximum("green", ["r"], "c", 3)).where("top").select("r", "c", F.round("green", 6).alias("v"))


@query(f"{_P}, {_PEAK}, m AS (SELECT r, median(prom) AS m FROM pk WHERE top GROUP BY r) SELECT r, c, round(prom, 6) AS prom FROM pk JOIN m USING (r) WHERE top AND prom > 0.2 * m")
def prominence(spark, sf_dir):
    """Peaks with more than a fifth of their row's median prominence."""
    p = S.pixels(spark, sf_dir).select("r", "c", "green", Q.local_maximum("green", ["r"], "c", 3).alias("top"), Q.prominence("green", ["r"], "c", 3).alias("prom")).where("top")
    m = p.groupBy("r").agg(F.percentile("prom", F.lit(0.5)).alias("m"))
    return p.join(m, "r").where(F.col("prom") > 0.2 * F.col("m")).select("r", "c", _r("prom"))


def _runs(gap: int) -> str:
    return f"r AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY row_id ORDER BY i) <= {gap + 1} THEN 0 ELSE 1 END AS new FROM low))"


@query(f"{_S}, low AS (SELECT * FROM series WHERE v < 45), {_runs(0)} SELECT row_id, min(i) AS first, max(i) AS last, count(*) AS n FROM r GROUP BY row_id, run")
def islands(spark, sf_dir):
    """W6."""
    return Q.islands(S.series(spark, sf_dir), BY, "i", F.col("v") < 45)


@query(f"{_S}, low AS (SELECT * FROM series WHERE v < 50), {_runs(0)} SELECT row_id, min(i) AS first, max(i) AS last, count(*) AS n FROM r GROUP BY row_id, run HAVING bool_or(v < 35)")
def hysteresis(spark, sf_dir):
    """Weak runs with a strong place."""
    return Q.hysteresis(S.series(spark, sf_dir), BY, "i", F.col("v") < 50, F.col("v") < 35)


@query(f"{_S}, low AS (SELECT * FROM series WHERE v < 45), {_runs(2)} SELECT row_id, min(i) AS first, max(i) AS last, count(*) AS n FROM r GROUP BY row_id, run")
def gap_fill(spark, sf_dir):
    """Runs at most two places apart are one."""
    return Q.islands(S.series(spark, sf_dir), BY, "i", F.col("v") < 45, 2)


_MERGE = """m AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY row_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS new FROM iv))"""


@query(f"{_I}, {_MERGE.format(gap=1)} SELECT row_id, min(a) AS a, round(max(b), 6) AS b, count(*) AS n FROM m GROUP BY row_id, run")
def merge_intervals(spark, sf_dir):
    """W12, I10."""
    return Q.merge_intervals(S.intervals(spark, sf_dir), BY, gap=1.0).select("row_id", "a", _r("b"), "n")


@query(f"""{_S}, k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY i) AS k, count(*) OVER (PARTITION BY row_id) AS n FROM series),
  l AS (SELECT row_id, greatest(1, 0.5 * coalesce(quantile_cont(v, 0.5) FILTER (k <= 4), 0)) AS l, greatest(1, 0.5 * coalesce(quantile_cont(v, 0.5) FILTER (k > n - 4), 0)) AS q FROM k GROUP BY row_id)
  SELECT row_id, min(i) FILTER (n <= 8 OR v >= l) AS first, max(i) FILTER (n <= 8 OR v >= q) AS last FROM k JOIN l USING (row_id) GROUP BY row_id""")
def half_height_trim(spark, sf_dir):
    """W13."""
    return Q.half_height_trim(S.series(spark, sf_dir), BY, "i", "v", 4)


_TOP = """t AS (SELECT r, max(pg) AS top, min(pg) AS base FROM pixel GROUP BY r), a AS (SELECT r, min(c) AS tat FROM pixel JOIN t USING (r) WHERE pg = top GROUP BY r)"""


@query(f"""{_P}, {_TOP}, low AS (SELECT r AS row_id, c AS i, tat FROM pixel JOIN t USING (r) JOIN a USING (r) WHERE pg >= base + 0.6::DOUBLE * (top - base)), {_runs(0)}
  SELECT row_id AS r, min(i)::INT AS first, max(i)::INT AS last, count(*) AS width FROM r GROUP BY row_id, run HAVING min(i) <= any_value(tat) AND any_value(tat) <= max(i)""")
def width_at_fraction(spark, sf_dir):
    """W15."""
    p = S.pixels(spark, sf_dir).select("r", "c", "green")
    return Q.width_at(p, ["r"], "c", "green", "green").select("r", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), "width")


@query(f"""{_S}, d AS (SELECT *, v - lag(v) OVER (PARTITION BY row_id ORDER BY i) AS d FROM series), o AS (SELECT *, sign(d) * sign(lag(d) OVER (PARTITION BY row_id ORDER BY i)) < 0 AS o FROM d WHERE d IS NOT NULL)
  SELECT row_id, count(*) AS pairs, round(avg((abs(d) >= 2)::INT), 6) AS large, round(avg(o::INT) FILTER (abs(d) >= 2), 6) AS opposite FROM o GROUP BY row_id""")
def sign_alternation(spark, sf_dir):
    """W18."""
    return Q.alternation(S.series(spark, sf_dir), BY, "i", "v", 2.0).select("row_id", "pairs", _r("large"), _r("opposite"))


@query(f"{_S} SELECT i, row_id, round(quantile_cont(v, 0.5) OVER (PARTITION BY i ORDER BY row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS m FROM series")
def neighbour_median(spark, sf_dir):
    """The median over the neighbouring rows at the same place."""
    f = Window.partitionBy("i").orderBy("row_id").rowsBetween(-2, 2)
    return S.series(spark, sf_dir).select("i", "row_id", _r(F.percentile("v", F.lit(0.5)).over(f), "m"))


@query("SELECT c_nationkey AS lot, c_custkey AS row_id, round(coalesce((lag(c_acctbal) OVER w + c_acctbal) / 2, c_acctbal), 6) AS lo, round(coalesce((lead(c_acctbal) OVER w + c_acctbal) / 2, c_acctbal), 6) AS hi FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
def row_edges(spark, sf_dir):
    """From the middle to the row before to the middle to the row after."""
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    v = F.col("c_acctbal")
    return S.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("lot"), F.col("c_custkey").alias("row_id"), _r(F.coalesce((F.lag(v).over(w) + v) / 2, v), "lo"), _r(F.coalesce((F.lead(v).over(w) + v) / 2, v), "hi"))


@query(f"""{_S}, p AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY row_id ORDER BY i) AS pi, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qi FROM series)
  SELECT p.row_id, p.i, round(CASE WHEN p.v IS NOT NULL THEN p.v WHEN pi IS NULL THEN q.v WHEN qi IS NULL THEN l.v ELSE l.v + (q.v - l.v) * (p.i - pi) / (qi - pi) END, 6) AS v
  FROM p LEFT JOIN daily l ON l.row_id = p.row_id AND l.i = pi LEFT JOIN daily q ON q.row_id = p.row_id AND q.i = qi""")
def interp_join(spark, sf_dir):
    """Unknown places by a straight line between known ones."""
    s = S.series(spark, sf_dir)
    return s.select("row_id", "i", _r(Q.interpolated(s, BY, "i", "v"), "v"))


@query(f"{_S} SELECT row_id, i, round(sum(v) OVER (PARTITION BY row_id ORDER BY i ROWS UNBOUNDED PRECEDING), 5) AS total, round(sum(v) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 5) AS strip FROM series")
def prefix_sums(spark, sf_dir):
    """W8."""
    w = Q.ordered(BY, "i")
    return S.series(spark, sf_dir).select("row_id", "i", F.round(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), 5).alias("total"), F.round(F.sum("v").over(w.rowsBetween(-4, 0)), 5).alias("strip"))


@query("SELECT s_nationkey AS lot, s_suppkey AS id, count(*) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal RANGE BETWEEN CURRENT ROW AND 1500 FOLLOWING) AS n FROM supplier")
def gap_line_count(spark, sf_dir):
    """How many values lie in the strip from each on."""
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal").rangeBetween(0, 1500)
    return S.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("lot"), F.col("s_suppkey").alias("id"), F.count(F.lit(1)).over(w).alias("n"))


@query("""WITH x AS (SELECT s_nationkey AS lot, s_suppkey AS id, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier),
  f AS (SELECT a.lot, a.id, a.k, a.v, regr_slope(b.v, b.k) AS s, regr_intercept(b.v, b.k) AS t, count(*) AS n FROM x a JOIN x b ON a.lot = b.lot AND abs(a.k - b.k) <= 4 AND a.k <> b.k GROUP BY ALL)
  SELECT lot, id, round(v - (t + s * k), 5) AS dev FROM f WHERE n >= 4""")
def row_end_border(spark, sf_dir):
    """How far each row's end lies from the line through its neighbours, up to four on each side, itself left out."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    x = S.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("lot"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"), F.row_number().over(w).alias("k"))
    near = x.select("lot", F.col("k").alias("kb"), F.col("v").alias("vb"), F.explode(F.array(*[F.lit(j) for j in (-4, -3, -2, -1, 1, 2, 3, 4)])).alias("j")).withColumn("k", F.col("kb") - F.col("j"))
    f = x.join(near, ["lot", "k"]).groupBy("lot", "id", "k", "v").agg(F.regr_slope("vb", "kb").alias("s"), F.regr_intercept("vb", "kb").alias("t"), F.count(F.lit(1)).alias("n"))
    return f.where("n >= 4").select("lot", "id", F.round(F.col("v") - (F.col("t") + F.col("s") * F.col("k")), 5).alias("dev"))


@query("SELECT c_nationkey AS lot, c_custkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer) WHERE k % 7 = 0")
def stride_sample(spark, sf_dir):
    """Every seventh of each lot, as the feature asks for."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    c = S.read(spark, sf_dir, "customer").withColumn("k", F.row_number().over(w) - 1)
    return c.where("k % 7 = 0").select(F.col("c_nationkey").alias("lot"), F.col("c_custkey").alias("id"))


@query(f"""{_S}, lv AS (SELECT quantile_cont(v, 0.2) AS base, quantile_cont(v, 0.75) AS ref FROM series), z AS (SELECT row_id, i, (v - base) / (ref - base) AS z FROM series, lv),
  zs AS (SELECT row_id, i, CASE WHEN count(z) OVER f * 2 >= 3 THEN quantile_cont(z, 0.5) OVER f END AS z FROM z WINDOW f AS (PARTITION BY row_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
  low AS (SELECT * FROM zs WHERE z < 0.5), {_runs(1)}, s AS (SELECT row_id, min(i) AS lo, max(i) AS hi FROM series GROUP BY row_id)
  SELECT row_id, first, last, last - first + 1 AS length, round(level, 6) AS level, (first - lo < 2 OR hi - last < 2)::INT AS edge
  FROM (SELECT row_id, min(i) AS first, max(i) AS last, avg(z) AS level FROM r GROUP BY row_id, run) JOIN s USING (row_id) WHERE last - first + 1 >= 2""")
def row_failures(spark, sf_dir):
    """X11 (tail), W4, W6, W9, W11, F16, G10, P10: levels from percentiles, normalised series, running median, runs below a half."""
    s = S.series(spark, sf_dir)
    levels = A.whole_levels(s, "v", base=0.2, ref=0.75)
    z = s.join(F.broadcast(levels)).select("row_id", "i", X.normalised("v", "base", "ref").alias("z"))
    return Q.failures(z, BY, "i", "z").select("row_id", "first", "last", "length", _r("level"), "edge")
