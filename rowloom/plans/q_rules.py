"""Queries on decisions and interval rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.functions import expr as X
from rowloom.operators import aggregate as A
from rowloom.operators import joins as J
from rowloom.operators import sequence as Q
from rowloom.plans import detect as D
from rowloom.plans.catalog import query
from rowloom.plans.q_join import _LOTS, lots
from rowloom.sources import scenes
from rowloom.sources import standins as S

_P, _S, _V = (f"WITH {x}" for x in (S.PIXELS_SQL, S.SERIES_SQL, S.VOTES_SQL))


def _r(c, alias=None):
    return F.round(c, 6).alias(alias or c)


@query(f"""{_V}, t AS (SELECT src, ang, per, ring FROM vote QUALIFY row_number() OVER (PARTITION BY src ORDER BY ring DESC, id) = 1)
  SELECT v.src, v.id FROM vote v JOIN t ON v.src = t.src WHERE v.ring >= 0.3 * t.ring AND least(abs(v.ang - t.ang), 180 - abs(v.ang - t.ang)) >= 45 AND v.per / t.per BETWEEN 1.1 AND 3 QUALIFY row_number() OVER (PARTITION BY v.src ORDER BY v.ring DESC, v.id) = 1""")
def lattice_peak(spark, sf_dir):
    """The strongest second peak that may be a lattice: across the first, with a longer period."""
    v = S.votes(spark, sf_dir)
    top = v.groupBy("src").agg(F.max(F.struct("ring", (-F.col("id")).alias("k"), "ang", "per")).alias("t"))
    c = v.join(top, "src").where((F.col("ring") >= 0.3 * F.col("t.ring")) & (X.angle_diff(v["ang"], F.col("t.ang")) >= 45) & (v["per"] / F.col("t.per")).between(1.1, 3))
    return c.groupBy("src").agg(F.max(F.struct(v["ring"], (-F.col("id")).alias("k"))).alias("m")).select("src", (-F.col("m.k")).alias("id"))


_ISL = """low AS (SELECT * FROM series WHERE v >= 40), r AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY row_id ORDER BY i) <= 1 THEN 0 ELSE 1 END AS new FROM low)),
  isl AS (SELECT row_id, min(i) AS a, max(i) AS b, count(*) AS n FROM r GROUP BY row_id, run)"""


@query(f"""{_S}, {_ISL}, k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY a) AS f, row_number() OVER (PARTITION BY row_id ORDER BY a DESC) AS l FROM isl)
  SELECT row_id, a, b, (f = 1 OR l = 1) AND n < 3 AS tail FROM k""")
def terminal_pieces(spark, sf_dir):
    """Short pieces at the ends of a row are candidates for tails."""
    isl = Q.islands(S.series(spark, sf_dir), ["row_id"], "i", F.col("v") >= 40)
    w = Window.partitionBy("row_id").orderBy("first")
    end = F.lag("first").over(w).isNull() | F.lead("first").over(w).isNull()
    return isl.select("row_id", F.col("first").alias("a"), F.col("last").alias("b"), (end & (F.col("n") < 3)).alias("tail"))


@query(f"""{_S}, {_ISL}, own AS (SELECT row_id, a, b FROM isl WHERE n >= 4), more AS (SELECT row_id, a, b FROM isl)
  SELECT own.row_id, own.a, own.b, least(own.a, min(more.a)) AS lo, greatest(own.b, max(more.b)) AS hi FROM own JOIN more ON more.row_id = own.row_id AND more.a <= own.b + 2 AND more.b >= own.a - 2 GROUP BY own.row_id, own.a, own.b""")
def plant_extension(spark, sf_dir):
    """Pieces grow over what lies within two places of them."""
    isl = Q.islands(S.series(spark, sf_dir), ["row_id"], "i", F.col("v") >= 40)
    own = isl.where("n >= 4").select("row_id", F.col("first").alias("a"), F.col("last").alias("b"), (F.col("first") - 2.5).alias("wa"), (F.col("last") + 2.5).alias("wb"))
    more = isl.select("row_id", (F.col("first") - 0.25).alias("c"), (F.col("last") + 0.25).alias("d"), F.col("first").alias("ma"), F.col("last").alias("mb"))
    o = J.interval_overlap(own, more, ["row_id"], 16.0, "wa", "wb", "c", "d")
    return o.groupBy("row_id", "a", "b").agg(F.least("a", F.min("ma")).alias("lo"), F.greatest("b", F.max("mb")).alias("hi"))


@query(f"{_S}, e AS (SELECT row_id % 10 AS lot, row_id, avg((v > 48)::INT) AS f FROM series WHERE v IS NOT NULL GROUP BY ALL) SELECT lot, count(*) >= 10 AND avg((f >= 0.5)::INT) < 0.3 AS pattern_mode FROM e GROUP BY lot")
def pattern_mode(spark, sf_dir):
    """Lots of many rows of which few have evidence are filled by their pattern."""
    e = S.series(spark, sf_dir).where("v IS NOT NULL").groupBy((F.col("row_id") % 10).alias("lot"), "row_id").agg(F.avg((F.col("v") > 48).cast("int")).alias("f"))
    return e.groupBy("lot").agg(((F.count(F.lit(1)) >= 10) & (F.avg((F.col("f") >= 0.5).cast("int")) < 0.3)).alias("pattern_mode"))


_CLIP = "x{n} AS (SELECT lot, k, x1 + (y - y1) * (x2 - x1) / (y2 - y1) AS x FROM {e} JOIN line ON (y1 <= y AND y < y2) OR (y2 <= y AND y < y1)), p{n} AS (SELECT lot, k, x, row_number() OVER w AS n, lead(x) OVER w AS xe FROM x{n} WINDOW w AS (PARTITION BY lot, k ORDER BY x)), l{n} AS (SELECT lot, k, sum(xe - x) AS len, count(*) AS pieces FROM p{n} WHERE n % 2 = 1 AND xe IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_LOTS}, inner_edge AS (SELECT lot, 10 + 0.8 * (x1 - 10) AS x1, 20.0 * lot + 10 + 0.8 * (y1 - 20.0 * lot - 10) AS y1, 10 + 0.8 * (x2 - 10) AS x2, 20.0 * lot + 10 + 0.8 * (y2 - 20.0 * lot - 10) AS y2 FROM edge), line AS (SELECT k, k * 1.5::DOUBLE AS y FROM range(0, 334) AS t(k)),
  {_CLIP.format(n=1, e='edge')}, {_CLIP.format(n=2, e='inner_edge')}
  SELECT l1.lot, l1.k, round(l1.len, 6) AS len, coalesce(l1.len < 0.5 * l2.len OR (l1.pieces >= 2 AND l1.len < 0.9 * l2.len), true) AS edge FROM l1 LEFT JOIN l2 ON l1.lot = l2.lot AND l1.k = l2.k""")
def contour_fit(spark, sf_dir):
    """Lines clipped by a contour; those that a smaller contour doesn't hold, or would hold better, are edge rows."""
    corner = lots(spark, sf_dir)
    shrunk = corner.select("lot", "j", (10 + 0.8 * (F.col("x") - 10)).alias("x"), (20.0 * F.col("lot") + 10 + 0.8 * (F.col("y") - 20.0 * F.col("lot") - 10)).alias("y"))
    cut = lambda c: J.scanlines(J.edges(c, ["lot"], "j"), ["lot"], 1.5).groupBy("lot", "k").agg(F.sum(F.col("x2") - F.col("x1")).alias("len"), F.count(F.lit(1)).alias("pieces"))
    small = cut(shrunk).select("lot", "k", F.col("len").alias("inner"))
    o = cut(corner).join(small, ["lot", "k"], "left")
    edge = F.coalesce((F.col("len") < 0.5 * F.col("inner")) | ((F.col("pieces") >= 2) & (F.col("len") < 0.9 * F.col("inner"))), F.lit(True))
    return o.select("lot", "k", _r("len"), edge.alias("edge"))


@query(f"{_S}, c AS (SELECT row_id, count(*) FILTER (v > 45) AS own, count(*) FILTER (v > 45 OR i % 3 = 0) AS band FROM series GROUP BY row_id) SELECT row_id, own, band, CASE WHEN own = 0 THEN band > 0 ELSE band >= 1.25 * own END AS moved FROM c")
def band_centre(spark, sf_dir):
    """Another centre is taken if the row is then seen over a quarter more of its length."""
    c = S.series(spark, sf_dir).groupBy("row_id").agg(F.count(F.when(F.col("v") > 45, 1)).alias("own"), F.count(F.when((F.col("v") > 45) | (F.col("i") % 3 == 0), 1)).alias("band"))
    return c.select("row_id", "own", "band", F.when(F.col("own") == 0, F.col("band") > 0).otherwise(F.col("band") >= 1.25 * F.col("own")).alias("moved"))


_NOISE = "CASE WHEN count(*) FILTER ({w} x < 0) >= 50 THEN sqrt(avg(x * x) FILTER ({w} x < 0)) ELSE 0.1 * quantile_cont(abs(x), 0.5) FILTER ({v} x IS NOT NULL) END"


@query(f"WITH e AS (SELECT event_type, value - 50 AS x, user_id % 3 AS k FROM events) SELECT event_type, round(least({_NOISE.format(w='', v='')}, {_NOISE.format(w='k > 0 AND', v='k > 0 AND')}), 6) AS sigma FROM e GROUP BY event_type")
def noise_reestimate(spark, sf_dir):
    """The noise away from rows, where it is lower than that of all."""
    e = S.read(spark, sf_dir, "events").select("event_type", (F.col("value") - 50).alias("x"), F.when(F.col("user_id") % 3 > 0, F.col("value") - 50).alias("off"))
    return e.groupBy("event_type").agg(_r(F.least(X.noise_rms("x"), X.noise_rms("off")), "sigma"))


@query(f"""{_P}, o AS (SELECT r // 50 AS blk, c // 5 AS part, c % 5 - 2 AS off, avg(pg) AS v FROM pixel GROUP BY ALL), b AS (SELECT blk, part, off FROM o QUALIFY row_number() OVER (PARTITION BY blk, part ORDER BY round(v, 9) DESC, off) = 1)
  SELECT blk::BIGINT AS blk, round(regr_slope(off, part), 6) AS slope, round(regr_intercept(off, part), 6) AS shift FROM b GROUP BY blk HAVING count(*) >= 4""")
def block_relocation(spark, sf_dir):
    """The best lateral place of each piece of a row, and a line through them."""
    o = S.pixels(spark, sf_dir).groupBy(F.floor(F.col("r") / 50).alias("blk"), F.floor(F.col("c") / 5).alias("part"), (F.col("c") % 5 - 2).alias("off")).agg(F.avg("green").alias("v"))
    b = o.groupBy("blk", "part").agg(F.min(F.struct((-F.round("v", 9)).alias("v"), "off")).alias("m")).select("blk", "part", F.col("m.off").cast("double").alias("off"))
    return A.ols(b.withColumn("part", F.col("part").cast("double")), ["blk"], "part", "off").where("n >= 4").select("blk", _r("slope"), _r("intercept", "shift"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size < 3 THEN 'period too small' WHEN p_retailprice > 1800 THEN 'raster too large' ELSE 'ok' END AS guard,
  CASE WHEN p_size > 24 THEN p_size // 12 ELSE 1 END::INT AS factor, CASE WHEN p_size < 6 THEN 0.5 ELSE 1.0 END::DOUBLE AS blur, p_size * 0.1 < 1.2 AS highpass FROM part""")
def work_decisions(spark, sf_dir):
    """What is refused, how far a raster is coarsened, how it is smoothed."""
    p, size = S.read(spark, sf_dir, "part"), F.col("p_size")
    guard = F.when(size < 3, "period too small").when(F.col("p_retailprice") > 1800, "raster too large").otherwise("ok")
    return p.select(F.col("p_partkey").alias("id"), guard.alias("guard"), F.when(size > 24, F.floor(size / 12)).otherwise(F.lit(1)).cast("int").alias("factor"), F.when(size < 6, F.lit(0.5)).otherwise(F.lit(1.0)).alias("blur"), (size < 12).alias("highpass"))


@query(f"""{_P}, w AS (SELECT r // 80 AS w, r // 4 AS r2, c // 3 AS c2, pg FROM pixel), d AS (SELECT w, r2, c2, avg(pg) AS m FROM w GROUP BY ALL), o AS (SELECT w, avg(pg) AS g FROM w GROUP BY w),
  l AS (SELECT w.w, avg(pow(pg - m, 2)) / avg(pow(pg - g, 2)) AS loss FROM w JOIN d USING (w, r2, c2) JOIN o USING (w) GROUP BY w.w) SELECT round(median(loss), 6) AS loss, median(loss) >= 0.03 AS detailed FROM l""")
def fine_detail(spark, sf_dir):
    """Whether the raster has detail that coarse pixels lose: the median over windows."""
    p = S.pixels(spark, sf_dir).select(F.floor(F.col("r") / 80).alias("w"), F.floor(F.col("r") / 4).alias("r2"), F.floor(F.col("c") / 3).alias("c2"), "green")
    cell = p.groupBy("w", "r2", "c2").agg(F.count(F.lit(1)).alias("n"), F.sum("green").alias("s"), F.sum(F.col("green") * F.col("green")).alias("q"))
    t = cell.groupBy("w").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("inner"))
    loss = F.col("inner") / (F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    m = t.agg(F.percentile(loss, F.lit(0.5)).alias("m"))
    return m.select(_r("m", "loss"), (F.col("m") >= 0.03).alias("detailed"))


@query()
def failures_by_lot(spark, sf_dir):
    """Lots on their own; one of noise alone has no contrast, and doesn't keep the others from their failures."""
    px = scenes.pixels(spark, scenes.Scene(lots=(0, 1))).withColumn("v", X.exg())
    noise = scenes.pixels(spark, scenes.Scene(lots=(2,))).withColumn("v", (F.pmod(F.xxhash64("r", "c"), F.lit(1000)) / 1000.0 - 0.5) * 0.02)
    both = px.unionByName(noise)
    o = D.run_scene(both)
    e = o["evidence"]
    contrast = e.groupBy("lot").agg((F.avg("con") / F.stddev_pop("con")).alias("k")).where("k >= 0.8").select("lot")
    return o["failures"].join(D.per_lot(contrast), "lot", "left_semi").select("lot", F.col("row_id").cast("int").alias("row_id"), F.col("first").cast("int").alias("first"), F.col("length").cast("int").alias("length"))


def _grid_sql() -> str:
    rows = [f"({s.lots[0]}, {len(s.gaps)}, {len(s.gaps)}, 0, true, true)" for s in scenes.grid()]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(lot, gaps, found, false_found, direction, good_rows)"


@query(_grid_sql())
def scene_grid(spark, sf_dir):
    """X1-X4, X11-X13 against the truth of scenes that differ in direction, spacing, phase and noise: the gaps of each, those found within
    three pixels at both ends, those found where none is, and whether direction, spacing and rows (F1 over 0.9) are right."""
    grid = scenes.grid()
    px = scenes.pixels(spark, grid[0])
    for s in grid[1:]:
        px = px.unionByName(scenes.pixels(spark, s))
    o = D.run_scene(px.withColumn("v", X.exg()))
    true = spark.createDataFrame([(s.lots[0], int(r), a, b, s.angle, s.period, s.phase) for s in grid for r, a, b in s.gaps], "lot int, row_id long, a double, b double, angle double, period double, phase double")
    # Found rows are numbered from the estimated phase, which may differ from the true one by whole spacings.
    lot = true.select("lot", "angle", "period", "phase").distinct()
    near = o["estimate"].join(lot, "lot").select("lot", ((X.angle_diff("ang", "angle") < 0.5) & (F.abs(F.col("per") - F.col("period")) < 0.15)).alias("direction"), "angle", "period", "phase")
    found = o["failures"].where("edge = 0").select("lot", "row_id", "first", "last")
    hit = true.join(found.withColumnRenamed("row_id", "own"), "lot").where((F.abs(F.col("first") - F.col("a")) <= 3) & (F.abs(F.col("last") - F.col("b")) <= 3))
    matched = hit.groupBy("lot").agg(F.count_distinct("row_id").alias("found"), F.count_distinct("own", "first").alias("real"))
    all_ = found.groupBy("lot").agg(F.count(F.lit(1)).alias("n"))
    x, y = F.col("c") + 0.5, F.col("r") + 0.5
    cell = lambda p, e: p.join(D.per_lot(e), "lot").withColumn("k", F.rint((X.across(x, y, F.col("angle")) - F.col("phase")) / F.col("period")).cast("long"))
    middle = cell(px, near).where(F.abs(X.across(x, y, F.col("angle")) - F.col("phase") - F.col("k") * F.col("period")) <= 1).select("lot", F.col("k").alias("row_id"), F.floor(X.along(x, y, F.col("angle"))).alias("i"))
    cells = o["rows"].withColumn("i", F.explode(F.sequence(F.col("a").cast("long"), F.col("b").cast("long")))).select("lot", "row_id", "i")
    both = cells.distinct().withColumn("f", F.lit(1)).join(middle.distinct().withColumn("t", F.lit(1)), ["lot", "row_id", "i"], "full").groupBy("lot").agg((2 * F.count(F.col("f") + F.col("t")) / (F.count("f") + F.count("t"))).alias("f1"))
    gaps = true.groupBy("lot").agg(F.count(F.lit(1)).cast("int").alias("gaps"))
    out = gaps.join(near, "lot").join(matched, "lot", "left").join(all_, "lot", "left").join(both, "lot", "left")
    zero = F.lit(0)
    return out.select("lot", "gaps", F.coalesce("found", zero).cast("int").alias("found"), (F.coalesce("n", zero) - F.coalesce("real", zero)).cast("int").alias("false_found"), "direction", F.coalesce(F.col("f1") > 0.9, F.lit(False)).alias("good_rows"))
