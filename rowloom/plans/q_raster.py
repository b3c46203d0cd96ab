"""Queries on neighbourhoods, graphs, ordered operators and scenes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.functions import expr as X
from rowloom.operators import aggregate as A
from rowloom.operators import graph, ordered, raster
from rowloom.operators import sequence as Q
from rowloom.plans import detect as D
from rowloom.plans.catalog import query
from rowloom.sources import scenes
from rowloom.sources import standins as S

_P, _S, _V = (f"WITH {x}" for x in (S.PIXELS_SQL, S.SERIES_SQL, S.VOTES_SQL))


def _r(c, alias=None):
    return F.round(c, 6).alias(alias or c)


_W = ", ".join(f"({k}, {g!r}::DOUBLE)" for k, g in zip(range(-3, 4), Q.gaussian_weights(1.0)))


@query(f"""{_P}, k(d, w) AS (VALUES {_W}), p AS (SELECT r, c, pg, (SELECT max(r) FROM pixel) AS rm FROM pixel),
  h AS (SELECT p.r, p.c, sum(k.w * q.pg) AS v, any_value(p.rm) AS rm FROM p, k, pixel q WHERE q.r = p.r AND q.c = greatest(0, least(20, p.c + d)) GROUP BY p.r, p.c)
  SELECT h.r, h.c, round(sum(k.w * q.v), 6) AS v FROM h, k, h q WHERE q.c = h.c AND q.r = greatest(0, least(h.rm, h.r + d)) GROUP BY h.r, h.c""")
def blur_2d(spark, sf_dir):
    """Gaussian with continued borders."""
    return raster.blur(S.pixels(spark, sf_dir).select("r", "c", F.col("green").alias("v")), "v", 1.0).select("r", "c", _r("v"))


@query(f"""{_P}, k(d, w) AS (VALUES {_W}), h AS (SELECT p.r, p.c, any_value(p.pg) AS pg, sum(k.w * q.pg) AS v FROM pixel p, k, pixel q WHERE q.r = p.r AND q.c = greatest(0, least(20, p.c + d)) GROUP BY p.r, p.c)
  SELECT r, c, round(pg - v, 6) AS ridge FROM h""")
def ridge_transform(spark, sf_dir):
    """a value less its smoothed surroundings."""
    return S.pixels(spark, sf_dir).select("r", "c", F.round(F.col("green") - Q.gaussian("green", ["r"], "c", 1.0), 6).alias("ridge"))


def _morph(f: str, src: str) -> str:
    return f"SELECT r, c, {f}(v) OVER (PARTITION BY c ORDER BY r RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM (SELECT r, c, {f}(v) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM {src})"


@query(f"{_P}, p AS (SELECT r, c, (pg > 140)::INT AS v FROM pixel), e AS ({_morph('min', 'p')}), o AS ({_morph('max', 'e')}), d AS ({_morph('max', 'o')}), q AS ({_morph('min', 'd')}) SELECT r, sum(v)::BIGINT AS cells FROM q GROUP BY r")
def morphology(spark, sf_dir):
    """An opening and a closing of 3 x 3."""
    p = S.pixels(spark, sf_dir).select("r", "c", (F.col("green") > 140).cast("int").alias("v"))
    return raster.closed(raster.opened(p, "v"), "v").groupBy("r").agg(F.sum("v").alias("cells"))


@query(f"""{_P}, m AS MATERIALIZED (SELECT r * 1048576 + c AS n, r, c FROM pixel WHERE pg > 165), e AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM m a, range(-1, 2) AS x(dr), range(-1, 2) AS y(dc), m b WHERE b.r = a.r + dr AND b.c = a.c + dc)""".replace("WITH", "WITH RECURSIVE", 1) + """,
  reach AS (SELECT n AS node, n AS low FROM m UNION SELECT e.b, reach.low FROM reach JOIN e ON e.a = reach.node WHERE reach.low < e.b), c AS (SELECT node, min(low) AS comp FROM reach GROUP BY node)
  SELECT comp::BIGINT AS comp, count(*) AS cells FROM c GROUP BY comp""")
def cell_components(spark, sf_dir):
    """8-connected components of a mask."""
    m = S.pixels(spark, sf_dir).where("green > 165").select("r", F.col("c").cast("long").alias("c"))
    return graph.cell_components(m).groupBy("comp").agg(F.count(F.lit(1)).alias("cells"))


@query(f"""{_P} SELECT slope::DOUBLE AS slope, floor(c - slope * (r - 250))::BIGINT AS bin, round(avg(pg), 6) AS v, count(*) AS n FROM pixel, (SELECT k / 8.0 AS slope FROM range(-4, 5) AS t(k)) GROUP BY ALL""")
def sheared_profile(spark, sf_dir):
    """The profile for each slope."""
    return raster.sheared_mean(S.pixels(spark, sf_dir), [], "r", "c", "green", [k / 8 for k in range(-4, 5)], 250.0).select("slope", "bin", _r("v"), "n")


@query(f"""{_P}, a AS (SELECT r, c, sum(x) OVER w AS s, sum(x * x) OVER w AS q, count(*) OVER w AS n FROM (SELECT r, c, pg - 128 AS x FROM pixel) WINDOW w AS (PARTITION BY r ORDER BY c RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
  b AS (SELECT r, c, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(n) OVER w AS n FROM a WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
  SELECT r, c, round(CASE WHEN n * 2 >= 45 THEN s / n / sqrt(greatest(q / n - (s / n) * (s / n), 1e-12) / greatest(n / 6.0, 1)) END, 5) AS t FROM b""")
def box_statistic(spark, sf_dir):
    """How far a box's mean is from 0 in standard errors."""
    p = S.pixels(spark, sf_dir).select("r", "c", (F.col("green") - 128).alias("x"))
    return raster.box_statistic(p, [], "r", "c", "x", 2, 4, 6.0).select("r", "c", F.round("t", 5).alias("t"))


_DFT = """tile AS (SELECT r // 16 AS t, r % 16 AS y, c AS x, pg FROM pixel WHERE c < 16 QUALIFY count(*) OVER (PARTITION BY r // 16) = 256), m AS (SELECT t, avg(pg) AS m FROM tile GROUP BY t),
  h AS (SELECT t, y, x, (pg - m) * (0.5 - 0.5 * cos(2 * pi() * y / 15)) * (0.5 - 0.5 * cos(2 * pi() * x / 15)) AS v FROM tile JOIN m USING (t)),
  f AS (SELECT t, ky, kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 16)) AS re, sum(v * sin(2 * pi() * (ky * y + kx * x) / 16)) AS im FROM h, range(0, 16) AS a(ky), range(0, 16) AS b(kx) GROUP BY ALL),
  p AS (SELECT t, re * re + im * im AS p, round_even(sqrt(pow(CASE WHEN ky > 8 THEN ky - 16 ELSE ky END, 2) + pow(CASE WHEN kx > 8 THEN kx - 16 ELSE kx END, 2)), 0) AS ring FROM f)"""


@query(f"{_P}, {_DFT} SELECT t::BIGINT AS tile, round(max(p) / 1000, 3) AS top, round(sum(p) FILTER (ring BETWEEN 2 AND 5) / 1000, 3) AS band FROM p GROUP BY t")
def tile_spectrum(spark, sf_dir):
    """Power spectra of all whole tiles of 16 x 16 under a Hann window; what is left over at the border has none."""
    return _spectra(S.pixels(spark, sf_dir), 256)


def _spectra(p, least):
    """tile, top, band of the tiles of 16 x 16 pixels of which `least` are there."""
    p = p.where("c < 16").select(F.floor(F.col("r") / 16).alias("tile"), (F.col("r") % 16).alias("r"), "c", "green")

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        a = raster.dense(pdf, "green", 16)
        if np.isfinite(a).sum() < least:
            return pd.DataFrame({"tile": [], "top": [], "band": []})
        p = raster.power(a)
        f = np.fft.fftfreq(16) * 16
        ring = np.rint(np.hypot(*np.meshgrid(f, f, indexing="ij")))
        return pd.DataFrame({"tile": pdf["tile"].head(1), "top": p.max() / 1000, "band": p[(ring >= 2) & (ring <= 5)].sum() / 1000})

    return p.groupBy("tile").applyInPandas(spectrum, "tile long, top double, band double").select("tile", F.round("top", 3).alias("top"), F.round("band", 3).alias("band"))


@query(f"""{_P}, x AS (SELECT r // 50 AS blk, k, avg(pg) AS v FROM pixel, range(0, 60) AS t(k) WHERE abs(c - (k * 0.1::DOUBLE) - 6.0 * round_even((c - k * 0.1::DOUBLE) / 6.0, 0)) <= 1.5 GROUP BY ALL)
  SELECT blk::BIGINT AS blk, round(k * 0.1::DOUBLE, 6) AS phase, round(v, 6) AS v FROM x QUALIFY row_number() OVER (PARTITION BY blk ORDER BY round(v, 9) DESC, k) = 1""")
def refine_phase(spark, sf_dir):
    """The phase, in a grid of candidates, under which the rows are brightest."""
    p = S.pixels(spark, sf_dir).select(F.floor(F.col("r") / 50).alias("blk"), "c", "green", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("k"))
    d = F.col("c") - F.col("k") * 0.1
    x = p.where(F.abs(d - 6.0 * F.rint(d / 6.0)) <= 1.5).groupBy("blk", "k").agg(F.avg("green").alias("v"))
    first = F.row_number().over(Window.partitionBy("blk").orderBy(F.desc(F.round("v", 9)), "k"))
    return x.withColumn("n", first).where("n = 1").select("blk", F.round(F.col("k") * 0.1, 6).alias("phase"), _r("v"))


@query("""WITH s AS (SELECT s_nationkey AS lot, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier GROUP BY ALL), g AS (SELECT lot, lo + 400.0::DOUBLE * k AS p FROM s, range(0, 40) AS t(k) WHERE lo + 400.0::DOUBLE * k <= hi)
  SELECT lot, count(*) AS free FROM g WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = lot AND abs(s_acctbal - p) <= 200) GROUP BY lot""")
def lattice_positions(spark, sf_dir):
    """Positions of a lattice between the outer rows that no row is near to."""
    s = S.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("lot"), F.col("s_acctbal").alias("v"))
    g = s.groupBy("lot").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    g = g.select("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / 400).cast("int"))).alias("k"), "lo").select("lot", (F.col("lo") + 400.0 * F.col("k")).alias("p"), F.floor((F.col("lo") + 400.0 * F.col("k")) / 400).alias("bin"))
    near = s.select("lot", "v", F.explode(F.array(*[F.floor(F.col("v") / 400) + j for j in (-1, 0, 1)])).alias("bin"))
    return g.join(near, (g["lot"] == near["lot"]) & (g["bin"] == near["bin"]) & (F.abs(near["v"] - g["p"]) <= 200), "left_anti").groupBy("lot").agg(F.count(F.lit(1)).alias("free"))


_SCORE = "((row_id * 7 + i * 3 + lv * 5 + (row_id * i) % 5) % 11 - 3)::DOUBLE"


@query(f"""WITH RECURSIVE {S.SERIES_SQL}, s AS MATERIALIZED (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) AS k, i FROM series), e AS MATERIALIZED (SELECT row_id, k, lv, greatest(-4, least(8, {_SCORE})) - abs(lv - 3) AS own FROM s, range(0, 7) AS t(lv)),
  v AS (SELECT row_id, k, lv, own AS best FROM e WHERE k = 1 UNION ALL
    SELECT e.row_id, e.k, e.lv, max(v.best - abs(v.lv - e.lv)) + any_value(e.own) FROM v JOIN e ON e.row_id = v.row_id AND e.k = v.k + 1 AND abs(e.lv - v.lv) <= 1 GROUP BY e.row_id, e.k, e.lv)
  SELECT row_id, max(best) AS total FROM v JOIN (SELECT row_id, max(k) AS n FROM s GROUP BY row_id) USING (row_id) WHERE k = n GROUP BY row_id""")
def viterbi_track(spark, sf_dir):
    """I4: the best lateral track through seven levels, one row per task group."""
    score = lambda lv: ((F.col("row_id") * 7 + F.col("i") * 3 + lv * 5 + F.col("row_id") * F.col("i") % 5) % 11 - 3).cast("double")
    s = S.series(spark, sf_dir).select("row_id", "i", F.transform(F.sequence(F.lit(0), F.lit(6)), score).alias("scores"))
    return ordered.viterbi_track(s, ["row_id"], "i", "scores").select("row_id", "total")


@query()
def row_grouping(spark, sf_dir):
    """Sorted positions stay together while near to the group's mean so far."""
    c = S.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("lot"), F.col("c_acctbal").alias("v"))
    return ordered.running_groups(c, ["lot"], "v", 60.0).groupBy("lot", "group").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("v"), "v"))


@query()
def vote_clusters(spark, sf_dir):
    """Greedy groups of votes without harmonics."""
    return ordered.vote_clusters(S.votes(spark, sf_dir), ["src"], angle=15.0, period=0.2, least_votes=3).select("src", "pattern", _r("ang"), _r("per"), "n")


@query()
def hinge_fit(spark, sf_dir):
    """A line with kinks per row, and its residual on places that were left out, against that of a straight line."""
    return ordered.hinge_fit(S.series(spark, sf_dir), ["row_id"], "i", "v", 2, 6.0).select("row_id", F.size("knots").alias("kinks"), _r("loss"), _r("even_odd"), _r("straight"), "accepted")


@query()
def cut_aligned_gaps(spark, sf_dir):
    """Lines across rows along which gaps align."""
    low = Q.islands(S.series(spark, sf_dir), ["row_id"], "i", F.col("v") < 45)
    g = low.select((F.col("row_id") % 5).alias("lot"), F.col("row_id").alias("row"), ((F.col("first") + F.col("last")) / 2).alias("mid"), F.lit(30).alias("rows"))
    return ordered.cut_aligned_gaps(g, ["lot"], 3.0).select("lot", _r("slope"), _r("at"), "n_rows")


@query()
def regular_ends(spark, sf_dir):
    """Row ends moved to the line through their neighbours' ends."""
    iv = S.intervals(spark, sf_dir).groupBy("row_id").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    rows = iv.select((F.col("row_id") % 5).alias("lot"), F.col("row_id").alias("row"), "a", "b")
    return ordered.regular_ends(rows, ["lot"], 8.0).select("lot", "row", "a", _r("b"), _r("lo"), _r("hi"))


@query("""SELECT c_custkey AS id, CASE WHEN sp >= 3.5 AND gs >= 0.3 AND cl >= 1.1 * cg THEN 'sunlit' WHEN cl > 0.06 THEN 'green' WHEN cl <= 0 AND abs(off) > 0.15 THEN 'dark' ELSE 'green' END AS stripe
  FROM (SELECT c_custkey, c_acctbal / 40000 AS cl, c_acctbal / 50000 AS cg, (c_custkey % 100) / 100.0 - 0.5 AS off, 1 + (c_custkey % 7) / 2.0 AS sp, (c_custkey % 10) / 10.0 AS gs FROM customer)""")
def stripe_decision(spark, sf_dir):
    """Which stripe is the row."""
    b = F.col("c_acctbal")
    k = D.stripe_kind(b / 40000, b / 50000, (F.col("c_custkey") % 100) / 100.0 - 0.5, 1 + (F.col("c_custkey") % 7) / 2.0, (F.col("c_custkey") % 10) / 10.0)
    return S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), k.alias("stripe"))


# Scenes with known truth: what SQL holds against them is the truth itself.


def _scene(spark):
    return scenes.pixels(spark).withColumn("v", X.exg())


@query("SELECT 0 AS lot, 30.0::DOUBLE AS ang, 12.0::DOUBLE AS per, 3.0::DOUBLE AS v0")
def scene_estimate(spark, sf_dir):
    """Direction, spacing and phase of a scene, to a tenth."""
    e = D.estimate(_scene(spark))
    return e.select("lot", F.round("ang", 1).alias("ang"), F.round("per", 1).alias("per"), F.round("v0", 1).alias("v0"))


@query("SELECT * FROM (VALUES (0, 2, 60, 30), (0, 5, 100, 30)) AS t(lot, row_id, first, length)")
def scene_failures(spark, sf_dir):
    """From pixels to failures; the scene has two between row ends."""
    o = D.run_scene(_scene(spark))
    return o["failures"].select("lot", F.col("row_id").cast("int").alias("row_id"), F.col("first").cast("int").alias("first"), F.col("length").cast("int").alias("length"))


@query("SELECT true AS good")
def row_f1(spark, sf_dir):
    """The scorer: cells of found rows against the true ones, without a gap at a row's end."""
    px = _scene(spark)
    o = D.run_scene(px)
    found = o["rows"].withColumn("i", F.explode(F.sequence(F.col("a").cast("long"), F.col("b").cast("long"))))
    s = scenes.Scene()
    x, y = F.col("c") + 0.5, F.col("r") + 0.5
    t, u = X.across(x, y, s.angle), X.along(x, y, s.angle)
    k = F.rint((t - s.phase) / s.period)
    true = px.where(F.abs(t - s.phase - k * s.period) <= 1.0).select("lot", k.cast("long").alias("row_id"), F.floor(u).alias("i"))
    return D.row_f1(found, true).select((F.col("f1") > 0.9).alias("good"))


@query("SELECT * FROM (VALUES (0, 'exg', true)) AS t(lot, name, wide)")
def analyze_rows(spark, sf_dir):
    """The index that stands out most along known rows, and whether its stripe has a row's width."""
    px = scenes.pixels(spark)
    est = spark.createDataFrame([(0, 30.0, 12.0, 3.0)], "lot int, ang double, per double, v0 double")
    c = D.analyze_rows(px, est)["choice"]
    return c.select("lot", "name", F.col("width").between(3, 8).alias("wide"))


@query("SELECT 0 AS lot, 1 AS parts")
def two_signal_blocks(spark, sf_dir):
    """The parts of a scene with one pattern."""
    b = D.two_signal_blocks(_scene(spark), "v")
    return b.groupBy("lot").agg(F.count(F.lit(1)).cast("int").alias("parts"))


@query("SELECT * FROM (VALUES (0, 12, 36, 900.0::DOUBLE, 2550.0::DOUBLE), (120, 12, 36, 900.0::DOUBLE, 2550.0::DOUBLE)) AS t(block, n_rows, n_segs, length, area)")
def infer_blocks(spark, sf_dir):
    """X7, P7, W4, W21, W22, N4-N6 by links between lines: two plantings of twelve rows each."""
    s = spark.range(24).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    y = 2.5 * F.col("i") + F.when(F.col("i") >= 12, F.lit(100.0)).otherwise(F.lit(0.0))
    s = s.select((F.col("i") * 10 + F.col("j")).alias("seg_id"), (30.0 * F.col("j")).alias("x1"), y.alias("y1"), (30.0 * F.col("j") + 25).alias("x2"), y.alias("y2"))
    b = D.infer_blocks(s, gap=6.0)["blocks"]
    return b.select("block", "n_rows", "n_segs", F.round("length", 6).alias("length"), F.round("area", 6).alias("area"))
