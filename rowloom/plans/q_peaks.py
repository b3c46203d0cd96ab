"""Queries on peaks and gates (W14, W16, W17, P9, P11, C1), each with SQL from its definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import peaks as K
from rowloom.operators import sequence as Q
from rowloom.plans import detect as D
from rowloom.plans.catalog import query
from rowloom.sources import standins as S

_P, _V, _G = (f"WITH {x}" for x in (S.PIXELS_SQL, S.VOTES_SQL, S.SEGMENTS_SQL))


def _r(c, alias=None):
    return F.round(c, 6).alias(alias or c)


@query(f"""{_P}, a AS (SELECT r, c AS k, pg AS top FROM pixel QUALIFY row_number() OVER (PARTITION BY r ORDER BY pg DESC, c) = 1),
  s AS (SELECT p.r, p.c, p.pg, k, top, lag(pg) OVER w AS before, lead(pg) OVER w AS after FROM pixel p JOIN a ON p.r = a.r WINDOW w AS (PARTITION BY p.r ORDER BY p.c)),
  n AS (SELECT * FROM s WHERE abs(c - k) <= 5),
  l AS (SELECT r, (any_value(top) + (min(pg) FILTER (c < k) + min(pg) FILTER (c > k)) / 2) / 2 AS lev FROM n GROUP BY r),
  x AS (SELECT n.r, c, k, CASE WHEN c < k THEN c + (lev - pg) / (after - pg) ELSE c - 1 + (before - lev) / (before - pg) END AS x FROM n JOIN l ON n.r = l.r WHERE pg < lev),
  f AS (SELECT r, arg_max(x, c) FILTER (c < k) AS xl, arg_min(x, c) FILTER (c > k) AS xr FROM x GROUP BY r)
  SELECT l.r, round((xl + xr) / 2, 6) AS centre FROM l LEFT JOIN f ON l.r = f.r""")
def half_height_center(spark, sf_dir):
    """The middle between the crossings of half the height on both sides of the highest peak, the base from the minima within 0.9 of a
    period of six."""
    p = S.pixels(spark, sf_dir).select("r", "c", "green")
    top = p.groupBy("r").agg((-F.max(F.struct(F.col("green"), (-F.col("c")).alias("b")))["b"]).alias("k"))
    return K.half_height_centers(p.join(top, "r"), ["r"], "c", "green", "k", 6.0).select("r", _r("centre"))


_SMOOTH = " + ".join(
    f"{g!r}::DOUBLE * " + ("q" if k == 0 else f"coalesce({'lag' if k < 0 else 'lead'}(q, {abs(k)}) OVER w, {'first' if k < 0 else 'last'}_value(q) OVER f)") for k, g in zip(range(-3, 4), Q.gaussian_weights(1.0))
)
_PEAKS = f"""v AS (SELECT r, c, CASE WHEN valid AND (r * 7 + c * 3) % 11 > 1 THEN pg END AS v FROM pixel),
  k AS (SELECT r, c, coalesce(v, min(v) OVER (PARTITION BY r)) AS q FROM v QUALIFY count(v) OVER (PARTITION BY r) >= 0.7 * count(*) OVER (PARTITION BY r)),
  m AS (SELECT r, c, {_SMOOTH} AS s FROM k WINDOW w AS (PARTITION BY r ORDER BY c), f AS (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  t AS (SELECT r, max(s) AS height, quantile_cont(s, 0.25) AS q FROM m GROUP BY r),
  peak AS (SELECT t.r, min(c) AS "at", any_value(height) AS height, any_value(height - q) AS prm FROM t JOIN m ON m.r = t.r AND m.s = t.height GROUP BY t.r)"""


def _peaks(spark, sf_dir):
    known = F.col("valid") & ((F.col("r") * 7 + F.col("c") * 3) % 11 > 1)
    return K.window_peaks(S.pixels(spark, sf_dir).select("r", "c", F.when(known, F.col("green")).alias("v")), ["r"], "c", "v", 1.0)


@query(f"""{_P}, {_PEAKS} SELECT r, "at", round(height, 6) AS height, round(prm, 6) AS prominence FROM peak""")
def window_peaks(spark, sf_dir):
    """Smoothed maximum of each profile and its prominence; profiles with less than 70 % known have none."""
    return _peaks(spark, sf_dir).select("r", "at", _r("height"), _r("prominence"))


@query(f"""{_P}, {_PEAKS}, b AS (SELECT r // 25 AS blk, r, "at", prm, quantile_cont(prm, 0.75) OVER (PARTITION BY r // 25) AS ref FROM peak)
  SELECT blk::BIGINT AS blk, r, "at" FROM (SELECT *, count(*) OVER (PARTITION BY blk) AS n FROM b WHERE prm >= 0.35 * ref) WHERE n >= 6""")
def clear_peaks(spark, sf_dir):
    """Peaks of at least 0.35 of their block's upper quartile, where six of them are."""
    p = _peaks(spark, sf_dir).withColumn("blk", F.floor(F.col("r") / 25))
    return K.clear_peaks(p, ["blk"]).select("blk", "r", "at")


@query(f"""{_P}, s AS (SELECT r // 200 AS row_id, r // 8 AS win, c, avg(CASE WHEN valid THEN pg END) AS m, count(CASE WHEN valid THEN pg END) AS n, count(*) AS k FROM pixel GROUP BY ALL),
  w AS (SELECT row_id, win, max(m) AS top, min(m) AS least, min(n) AS n, max(k) AS k FROM s GROUP BY ALL)
  SELECT w.row_id::BIGINT AS row_id, w.win::BIGINT AS win, any_value(w.win * 8 + w.k / 2) AS at, min(c) AS lateral FROM w JOIN s ON s.row_id = w.row_id AND s.win = w.win AND s.m = w.top WHERE w.n >= 0.5 * w.k AND top - least >= 60 GROUP BY ALL""")
def lateral_peaks(spark, sf_dir):
    """The best lateral place of each stretch of a row, where it stands out."""
    p = S.pixels(spark, sf_dir).select(F.floor(F.col("r") / 200).alias("row_id"), "r", "c", F.when(F.col("valid"), F.col("green")).alias("v"))
    return K.lateral_peaks(p, ["row_id"], "r", "c", "v", 8, 60.0).select("row_id", "win", "at", "lateral")


@query(f"""{_G}, l AS (SELECT lot_id, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM seg)
  SELECT lot_id, count(*) FILTER (len >= 4) AS for_failures, round(coalesce(sum(len) FILTER (len >= 4), 0), 4) AS metres, count(*) FILTER (len >= 20) AS for_spacing FROM l GROUP BY lot_id""")
def row_gates(spark, sf_dir):
    """Rows of 4 m and more go to the failures, of 20 m and more to the plants' spacing."""
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2.0)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2.0)))
    rows = S.segments(spark, sf_dir).select("lot_id", length.alias("length"))
    failing, spacing = D.long_enough("length", D.FAILURE_M), D.long_enough("length", D.SPACING_M)
    return rows.groupBy("lot_id").agg(F.count(F.when(failing, 1)).alias("for_failures"), F.round(F.coalesce(F.sum(F.when(failing, F.col("length"))), F.lit(0.0)), 4).alias("metres"), F.count(F.when(spacing, 1)).alias("for_spacing"))


@query(f"""{_V}, g AS (SELECT src, ang, per, ring FROM vote WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY ring DESC, id) = 1),
  b AS (SELECT src, ang, per, ring FROM vote WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY src ORDER BY ring * (1 + id % 4) DESC, id) = 1),
  j AS (SELECT g.src, g.ang AS ga, g.per AS gp, g.ring AS gr, b.ang AS ba, b.per AS bp, b.ring AS br, least(abs(g.ang - b.ang), 180 - abs(g.ang - b.ang)) AS d, left(g.src, 7) = 'Brand#1' AS forced FROM g LEFT JOIN b ON g.src = b.src),
  s AS (SELECT *, coalesce(abs(bp - gp) <= 0.1 * gp AND d <= 2, false) AS same FROM j), k AS (SELECT *, coalesce(NOT same AND br / 1000 >= 1 AND bp / gp BETWEEN 1.1 AND 3 AND d >= 45, false) AS crossed FROM s)
  SELECT src, crossed, ba IS NOT NULL AND (forced OR crossed OR (same AND br > 3 * gr)) AS swapped, round(CASE WHEN crossed OR (same AND (forced OR br > 3 * gr)) THEN bp ELSE gp END, 6) AS per FROM k""")
def index_swap(spark, sf_dir):
    """Where the brightness has the rows and the green only the plants across them, or has the same pattern much more strongly, or
    is asked for, the rows are sought in it."""
    v = S.votes(spark, sf_dir)
    first = lambda rows, score, name: rows.groupBy("src").agg(F.max(F.struct(score.alias("s"), (-F.col("id")).alias("k"), "ang", "per", F.col("ring").alias("peak"))).alias(name))
    g, b = first(v.where("id % 2 = 0"), F.col("ring"), "g"), first(v.where("id % 2 = 1"), F.col("ring") * (1 + F.col("id") % 4), "b")
    j = g.join(b, "src", "left").withColumn("white", F.col("b.peak") / 1000)
    d = D.index_swap(F.col("g"), F.col("b"), F.col("white"), F.col("src").startswith("Brand#1"))
    return j.select("src", d["crossed"].alias("crossed"), d["swapped"].alias("swapped"), F.round(d["per"], 6).alias("per"))
