"""Queries on aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.functions import expr as X
from rowloom.operators import aggregate as A
from rowloom.plans.catalog import query
from rowloom.sources import standins as S

_P, _S, _V, _G, _I = (f"WITH {x}" for x in (S.PIXELS_SQL, S.SERIES_SQL, S.VOTES_SQL, S.SEGMENTS_SQL, S.INTERVALS_SQL))
_EXG = "(2 * pg - pr - pb) / (pr + pg + pb + 1e-6)"
_T30 = "(-c * sin(radians(30)) + r * cos(radians(30)))"


def _r(c, alias=None):
    return F.round(c, 6).alias(alias or c)


@query(f"{_P} SELECT floor({_T30} / 1.5)::BIGINT AS bin, round(avg({_EXG}), 6) AS v, count(*) AS n FROM pixel WHERE valid GROUP BY ALL")
def binned_profile(spark, sf_dir):
    """G1: mean index per bin across a direction."""
    p = S.pixels(spark, sf_dir).where("valid")
    return A.binned_profile(p, [], X.across("c", "r", 30.0), X.exg(), 1.5).select("bin", _r("v"), "n")


@query(f"""{_P}, a AS (SELECT unnest(range(0, 180, 15)) AS ang), b AS (
  SELECT ang, floor((-c * sin(radians(ang)) + r * cos(radians(ang))) / 1.5) AS bin, avg({_EXG}) AS v, count(*) AS n FROM pixel, a WHERE valid GROUP BY ALL)
  SELECT ang::DOUBLE AS ang, round(sum(n * v * v) / sum(n) - pow(sum(n * v) / sum(n), 2), 8) AS contrast FROM b GROUP BY ang""")
def profile_contrast(spark, sf_dir):
    """The contrast of the profile for each of 12 directions; the candidates are a row of literals."""
    p = S.pixels(spark, sf_dir).where("valid").select("r", "c", X.exg().alias("v"), F.explode(F.array(*[F.lit(float(a)) for a in range(0, 180, 15)])).alias("ang"))
    prof = A.binned_profile(p, ["ang"], X.across("c", "r", F.col("ang")), "v", 1.5)
    return A.profile_contrast(prof, ["ang"]).select("ang", F.round("contrast", 8).alias("contrast"))


@query(f"{_V} SELECT src, round(CASE WHEN a < 0 THEN a + 180 ELSE a END, 6) AS ang FROM (SELECT src, degrees(atan2(sum(ring * sin(radians(2 * ang))), sum(ring * cos(radians(2 * ang))))) / 2 AS a FROM vote GROUP BY src)")
def circular_mean(spark, sf_dir):
    return S.votes(spark, sf_dir).groupBy("src").agg(_r(X.circular_mean("ang", "ring"), "ang"))


@query(f"{_V} SELECT src, round(sum(per * ring) / sum(ring), 6) AS per FROM vote GROUP BY src")
def weighted_mean(spark, sf_dir):
    return S.votes(spark, sf_dir).groupBy("src").agg(_r(X.weighted_mean("per", "ring"), "per"))


@query("SELECT event_type, round(CASE WHEN count(*) FILTER (x < 0) >= 50 THEN sqrt(avg(x * x) FILTER (x < 0)) ELSE 0.1 * median(abs(x)) END, 6) AS noise FROM (SELECT event_type, value - 40 AS x FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def noise_rms(spark, sf_dir):
    e = S.read(spark, sf_dir, "events").select("event_type", (F.col("value") - 40).alias("x"))
    return e.groupBy("event_type").agg(_r(X.noise_rms("x"), "noise"))


@query(f"""{_P} SELECT r, round(quantile_cont({_EXG}, 0.2), 6) AS p20, round(quantile_cont({_EXG}, 0.5), 6) AS p50, round(quantile_cont({_EXG}, 0.75), 6) AS p75, round(quantile_cont({_EXG}, 0.99), 6) AS p99 FROM pixel WHERE valid GROUP BY r""")
def percentile_levels(spark, sf_dir):
    p = S.pixels(spark, sf_dir).where("valid").select("r", X.exg().alias("v"))
    return A.levels(p, ["r"], "v", p20=0.2, p50=0.5, p75=0.75, p99=0.99).select("r", *[_r(c) for c in ("p20", "p50", "p75", "p99")])


_FOURIER = "sum(pg * cos(2 * pi() * c / {t})) AS cs, sum(pg * sin(2 * pi() * c / {t})) AS sn, count(*) AS n"


@query(f"{_P} SELECT r, round(sqrt(cs * cs + sn * sn) / n, 6) AS amplitude FROM (SELECT r, {_FOURIER.format(t='7.0')} FROM pixel GROUP BY r)")
def fourier_amp(spark, sf_dir):
    """Amplitude at one period, per row."""
    return A.fourier(S.pixels(spark, sf_dir), ["r"], "c", "green", F.lit(7.0)).select("r", _r("amplitude"))


@query(f"""{_P}, t AS (SELECT 7.0::DOUBLE * (1 + 0.01 * k) AS t FROM range(-6, 7) AS x(k)), f AS (
  SELECT r // 50 AS blk, t, {_FOURIER.format(t='t')} FROM pixel, t GROUP BY ALL)
  SELECT blk::BIGINT AS blk, round(t, 6) AS period, round(sqrt(cs * cs + sn * sn) / n, 6) AS amplitude FROM f QUALIFY row_number() OVER (PARTITION BY blk ORDER BY round(sqrt(cs * cs + sn * sn) / n, 9) DESC, t) = 1""")
def fourier_phase_scan(spark, sf_dir):
    """The period of a grid of candidates with the largest amplitude, per block of rows."""
    p = S.pixels(spark, sf_dir).select(F.floor(F.col("r") / 50).alias("blk"), "c", "green", F.explode(F.array(*[F.lit(7.0 * (1 + 0.01 * k)) for k in range(-6, 7)])).alias("t"))
    f = A.fourier(p, ["blk", "t"], "c", "green", F.col("t"))
    first = F.row_number().over(Window.partitionBy("blk").orderBy(F.desc(F.round("amplitude", 9)), "t"))
    return f.withColumn("k", first).where("k = 1").select("blk", _r("t", "period"), _r("amplitude"))


_AC = """m AS (SELECT row_id, avg(v) AS m FROM series GROUP BY row_id), x AS (SELECT row_id, i, v - m AS x FROM series JOIN m USING (row_id) WHERE v IS NOT NULL),
  ac AS (SELECT lag, sum(a.x * b.x) / sum(a.x * a.x) AS rr FROM x a, range(0, 11) AS l(lag), x b WHERE b.row_id = a.row_id AND b.i = a.i + lag GROUP BY lag)"""


@query(f"{_S}, {_AC} SELECT lag::INT AS lag, round(rr, 6) AS r FROM ac")
def autocorr(spark, sf_dir):
    """G20."""
    return A.autocorrelation(S.series(spark, sf_dir), ["row_id"], "i", "v", 10).select("lag", _r("r"))


@query(f"""{_S}, {_AC} SELECT lag::INT AS spacing, round(rr, 6) AS r FROM (SELECT *, lag(rr) OVER (ORDER BY lag) AS p, lead(rr) OVER (ORDER BY lag) AS q FROM ac) WHERE lag >= 2 AND rr > p AND rr >= q ORDER BY lag LIMIT 1""")
def plant_spacing(spark, sf_dir):
    """The first maximum of the autocorrelation (a dozen rows by then)."""
    ac = A.autocorrelation(S.series(spark, sf_dir), ["row_id"], "i", "v", 10)
    w = Window.orderBy("lag")
    ac = ac.select("lag", "r", F.lag("r").over(w).alias("p"), F.lead("r").over(w).alias("q"))
    return ac.where("lag >= 2 AND r > p AND r >= q").orderBy("lag").limit(1).select(F.col("lag").alias("spacing"), _r("r"))


@query(f"""{_S}, f AS (SELECT row_id, regr_count(v, i) AS n, regr_slope(v, i) AS b, regr_intercept(v, i) AS a, regr_sxx(v, i) AS xx, regr_syy(v, i) AS yy, regr_sxy(v, i) AS xy FROM series GROUP BY row_id)
  SELECT row_id, n::BIGINT AS n, round(b, 6) AS slope, round(a, 6) AS intercept, coalesce(abs(b) > 2 * sqrt(greatest(yy - b * xy, 0) / (n - 2) / xx), false) AS significant FROM f WHERE n > 3""")
def ols_slope_sig(spark, sf_dir):
    """A row's slope, and whether it is more than twice its error."""
    return A.ols(S.series(spark, sf_dir), ["row_id"], "i", "v").where("n > 3").select("row_id", "n", _r("slope"), _r("intercept"), "significant")


@query("SELECT c_nationkey AS lot, c_mktsegment AS mode, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def mode_vote(spark, sf_dir):
    """G12, J18."""
    return A.mode(S.read(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment").select(F.col("c_nationkey").alias("lot"), F.col("c_mktsegment").alias("mode"), "n")


@query(f"""{_S}, l AS (SELECT row_id, min(i) AS lo, max(i) - min(i) + 1 AS n FROM series GROUP BY row_id), w AS (
  SELECT row_id, least((i - lo) // 5, greatest(n // 5 - CASE WHEN (n % 5) * 2 >= 5 THEN 0 ELSE 1 END, 0)) AS win, v FROM series JOIN l USING (row_id))
  SELECT row_id, win::BIGINT AS win, round(CASE WHEN count(v) * 2 >= count(*) THEN avg(v) END, 6) AS z, round(CASE WHEN count(v) * 2 >= count(*) THEN 100 * avg((v >= 40)::INT) END, 6) AS presence,
    CASE WHEN count(v) * 2 >= count(*) THEN avg((v < 40)::INT) >= 0.5 END AS failing FROM w GROUP BY row_id, win""")
def window_agg(spark, sf_dir):
    """Means, presence and failure per window; a short last window joins the one before it."""
    return A.window_means(S.series(spark, sf_dir), ["row_id"], "i", "v", 5, 40.0).select("row_id", "win", _r("z"), _r("presence"), "failing")


@query(f"""{_P}, d AS (SELECT r // 4 AS r2, c // 3 AS c2, avg(pg) AS m FROM pixel GROUP BY ALL), o AS (SELECT avg(pg) AS g FROM pixel)
  SELECT round(avg(pow(pg - m, 2)) / avg(pow(pg - g, 2)), 6) AS loss FROM pixel JOIN d ON r // 4 = r2 AND c // 3 = c2, o""")
def detail_ratio(spark, sf_dir):
    """The share of the variance that is lost in coarse pixels."""
    p = S.pixels(spark, sf_dir).select(F.floor(F.col("r") / 4).alias("r2"), F.floor(F.col("c") / 3).alias("c2"), "green")
    cell = p.groupBy("r2", "c2").agg(F.count(F.lit(1)).alias("n"), F.sum("green").alias("s"), F.sum(F.col("green") * F.col("green")).alias("q"))
    t = cell.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("inner"))
    return t.select(_r(F.col("inner") / (F.col("q") - F.col("s") * F.col("s") / F.col("n")), "loss"))


@query(f"{_S} SELECT row_id, round(100.0 * sum((v < 40)::INT) / count(v), 6) AS failure_pct, round(100.0 * sum((v < 40 AND i BETWEEN 3 AND 26)::INT) / count(v), 6) AS inner_pct FROM series GROUP BY row_id")
def failure_pct(spark, sf_dir):
    """In all and away from the ends."""
    low = F.col("v") < 40
    s = S.series(spark, sf_dir).groupBy("row_id").agg(F.sum(low.cast("int")).alias("a"), F.sum((low & F.col("i").between(3, 26)).cast("int")).alias("b"), F.count("v").alias("n"))
    return s.select("row_id", _r(100.0 * F.col("a") / F.col("n"), "failure_pct"), _r(100.0 * F.col("b") / F.col("n"), "inner_pct"))


@query("SELECT o_orderpriority AS lot, round(avg((o_orderstatus = 'F')::INT), 6) AS accepted, round(quantile_cont(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 0.5), 6) AS median_dev FROM orders GROUP BY ALL")
def acceptance_rate(spark, sf_dir):
    """G32."""
    ok = F.col("o_orderstatus") == "F"
    return S.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("lot")).agg(_r(F.avg(ok.cast("int")), "accepted"), _r(F.percentile(F.when(ok, F.col("o_totalprice")), F.lit(0.5)), "median_dev"))


@query(f"{_G} SELECT lot_id, count(*) AS segments, count(DISTINCT x1) AS n_rows, round(min(y1), 6) AS lo, round(max(y2), 6) AS hi, round(sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))), 4) AS len FROM seg GROUP BY lot_id")
def row_extents(spark, sf_dir):
    """G30, G37, G38."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return S.segments(spark, sf_dir).groupBy("lot_id").agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("x1").alias("n_rows"), _r(F.min("y1"), "lo"), _r(F.max("y2"), "hi"), F.round(F.sum(X.length(dx, dy)), 4).alias("len"))


@query(f"""{_P}, v AS (SELECT name, CASE name WHEN 'exg' THEN {_EXG} WHEN 'gli' THEN (2 * pg - pr - pb) / (2 * pg + pr + pb + 1e-6) ELSE (pg - pr) / (pg + pr + 1e-6) END AS v, c FROM pixel, (VALUES ('exg'), ('gli'), ('ngrdi')) AS n(name) WHERE valid),
  b AS (SELECT name, c, avg(v) AS m FROM v GROUP BY ALL), s AS (SELECT name, stddev_pop(v) AS sd FROM v GROUP BY name)
  SELECT name, round((max(m) - min(m)) / any_value(sd), 6) AS contrast FROM b JOIN s USING (name) GROUP BY name QUALIFY row_number() OVER (ORDER BY round((max(m) - min(m)) / any_value(sd), 9) DESC, name) = 1""")
def index_selection(spark, sf_dir):
    """The index whose profile stands out most."""
    p = S.pixels(spark, sf_dir).where("valid")
    long = p.select("c", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), X.index(n).alias("v")) for n in ("exg", "gli", "ngrdi")])).alias("x")).select("c", "x.name", "x.v")
    bins = long.groupBy("name", "c").agg(F.avg("v").alias("m"), F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    n = F.sum("n")
    per = bins.groupBy("name").agg(((F.max("m") - F.min("m")) / F.sqrt(F.sum("q") / n - F.pow(F.sum("s") / n, F.lit(2.0)))).alias("contrast"))
    return per.orderBy(F.desc(F.round("contrast", 9)), "name").limit(1).select("name", _r("contrast"))


@query(f"{_P} SELECT rint_::INT AS ring, round(greatest(median(pg), 1e-30), 6) AS m FROM (SELECT round_even(sqrt(pow(r - 250.0, 2) + pow(c - 10.0, 2)), 0) AS rint_, pg FROM pixel) GROUP BY rint_")
def ring_median(spark, sf_dir):
    """G13."""
    p = S.pixels(spark, sf_dir)
    return A.ring_median(p, [], F.sqrt(F.pow(F.col("r") - 250.0, F.lit(2.0)) + F.pow(F.col("c") - 10.0, F.lit(2.0))), "green").select("ring", _r("m"))


@query(f"""{_P}, b AS (SELECT r // 25 AS blk, c, avg(pg) AS m FROM pixel GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY m, c) AS k, count(*) OVER (PARTITION BY blk) AS n FROM b)
  SELECT blk::BIGINT AS blk, round(avg(m) FILTER (k <= greatest(3, n // 5)), 6) AS base, round(max(m), 6) AS peak FROM k GROUP BY blk""")
def base_level(spark, sf_dir):
    """The mean of the lowest fifth of the bins, three at least."""
    b = S.pixels(spark, sf_dir).groupBy(F.floor(F.col("r") / 25).alias("blk"), "c").agg(F.avg("green").alias("m"))
    w = Window.partitionBy("blk")
    k = b.select("blk", "m", F.row_number().over(w.orderBy("m", "c")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return k.groupBy("blk").agg(_r(F.avg(F.when(F.col("k") <= F.greatest(F.lit(3), F.floor(F.col("n") / 5)), F.col("m"))), "base"), _r(F.max("m"), "peak"))


@query(f"""{_P}, p AS (SELECT *, CASE WHEN pg > (SELECT quantile_cont(pg, 0.75) FROM pixel) THEN 'strong' ELSE 'weak' END AS kind FROM pixel WHERE valid)
  SELECT round(median(pg) FILTER (kind = 'strong'), 6) AS hi, round(median(pg) FILTER (kind = 'weak'), 6) AS lo, count(*) FILTER (kind = 'strong') >= 10 AS enough FROM p""")
def typical_levels(spark, sf_dir):
    """Medians of strong and other samples."""
    all_ = S.pixels(spark, sf_dir)
    cut = all_.agg(F.percentile("green", F.lit(0.75)).alias("cut"))
    p = all_.where("valid").join(F.broadcast(cut))
    strong = F.col("green") > F.col("cut")
    return p.agg(_r(F.percentile(F.when(strong, F.col("green")), F.lit(0.5)), "hi"), _r(F.percentile(F.when(~strong, F.col("green")), F.lit(0.5)), "lo"), (F.count(F.when(strong, 1)) >= 10).alias("enough"))


@query(f"{_I} SELECT row_id, round(sum((b - a + 1) * (a % 17)) / sum(b - a + 1), 6) AS level FROM iv GROUP BY row_id")
def row_level(spark, sf_dir):
    """The mean level of a row's intervals, weighted by their lengths."""
    n = F.col("b") - F.col("a") + 1
    return S.intervals(spark, sf_dir).groupBy("row_id").agg(_r(F.sum(n * (F.col("a") % 17)) / F.sum(n), "level"))


@query(f"""{_P}, w AS (SELECT r // 50 AS blk, ratio, c, pg FROM pixel, (SELECT 0.70 + 0.05 * k AS ratio FROM range(0, 15) AS x(k))),
  f AS (SELECT blk, ratio, sum(pg * cos(2 * pi() * c / (6.0 * ratio))) AS cs, sum(pg * sin(2 * pi() * c / (6.0 * ratio))) AS sn, count(*) AS n FROM w GROUP BY ALL)
  SELECT blk::BIGINT AS blk, round(ratio::DOUBLE, 6) AS ratio FROM f QUALIFY row_number() OVER (PARTITION BY blk ORDER BY round(sqrt(cs * cs + sn * sn) / n, 9) DESC, ratio) = 1""")
def local_spacing(spark, sf_dir):
    """Per window, the ratio to the expected spacing with most amplitude."""
    p = S.pixels(spark, sf_dir).select(F.floor(F.col("r") / 50).alias("blk"), "c", "green", F.explode(F.array(*[F.lit(round(0.70 + 0.05 * k, 2)) for k in range(15)])).alias("ratio"))
    f = A.fourier(p, ["blk", "ratio"], "c", "green", 6.0 * F.col("ratio"))
    first = F.row_number().over(Window.partitionBy("blk").orderBy(F.desc(F.round("amplitude", 9)), "ratio"))
    return f.withColumn("k", first).where("k = 1").select("blk", _r("ratio"))


@query(f"""{_P}, x AS (SELECT r // 50 AS blk, r, k, sum(pg * cos(2 * pi() * (c - k * 0.5) / 6.0)) AS cs, sum(pg * sin(2 * pi() * (c - k * 0.5) / 6.0)) AS sn, count(*) AS n FROM pixel, range(0, 3) AS t(k) GROUP BY ALL)
  SELECT blk::BIGINT AS blk, round(avg(sqrt(cs * cs + sn * sn) / n), 6) AS beat FROM x GROUP BY blk""")
def lattice_beat(spark, sf_dir):
    """Amplitude along each row at three phases, averaged."""
    p = S.pixels(spark, sf_dir).select(F.floor(F.col("r") / 50).alias("blk"), "r", "green", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"), "c").withColumn("u", F.col("c") - F.col("k") * 0.5)
    return A.fourier(p, ["blk", "r", "k"], "u", "green", F.lit(6.0)).groupBy("blk").agg(_r(F.avg("amplitude"), "beat"))
