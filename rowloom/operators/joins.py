"""Joins by place: nearest, as-of, bands, interval overlap, lines and polygons. Each is an equi-join on computed keys, with the
rest of the condition behind it, so that it is planned as a hash or sort-merge join and never pairs all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], left_pos: str, right_pos: str, value: str) -> DataFrame:
    """left with near (the value of the nearest right row of its group; the lower one of two as near) and dist (signed). One
    union and two running windows: nothing is paired."""
    cols = [c for c in left.columns]
    a = left.select(*by, F.col(left_pos).alias("_p"), F.struct(*cols).alias("_row"), F.lit(None).cast("struct<p:double,v:string>").alias("_m"))
    b = right.select(*by, F.col(right_pos).cast("double").alias("_p"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(F.col(right_pos).cast("double").alias("p"), F.col(value).cast("string").alias("v")).alias("_m"))
    u = a.withColumn("_p", F.col("_p").cast("double")).unionByName(b)
    w = Window.partitionBy(*by).orderBy("_p", F.col("_m").isNull().cast("int"))
    back = F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    u = u.select(*by, "_p", "_row", back.alias("_b"), ahead.alias("_a")).where("_row IS NOT NULL")
    near = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(F.col("_p") - F.col("_b.p") <= F.col("_a.p") - F.col("_p"), F.col("_b")).otherwise(F.col("_a"))
    return u.withColumn("_n", near).select("_row.*", F.col("_n.v").alias("near"), (F.col("_p") - F.col("_n.p")).alias("dist"))


def band_pairs(df: DataFrame, by: list[str], position: str, width: float, key: str) -> DataFrame:
    """Pairs of rows of a group whose positions differ by (0, width]: by, a and b (structs of the two rows). Positions fall in bins of
    this width; each row meets its own and the next bin."""
    s = df.select(*by, F.struct(*df.columns).alias("a"), F.floor(F.col(position) / width).alias("_bin"))
    t = s.select(*by, F.col("a").alias("b"), F.explode(F.array(F.col("_bin"), F.col("_bin") - 1)).alias("_bin"))
    d = F.col(f"b.{position}") - F.col(f"a.{position}")
    return s.join(t, [*by, "_bin"]).where((d > 0) & (d <= width) & (F.col(f"a.{key}") != F.col(f"b.{key}"))).drop("_bin")


def nearest_beside(df: DataFrame, by: list[str], position: str, least: float, most: float, key: str, a: str, b: str, rounds: int = 4) -> DataFrame:
    """by, key, d: how far the nearest row of the group lies beyond `least` and up to `most` whose span from a to b overlaps. Reaches double,
    and rows that have found theirs leave, so that a crowded row meets its near neighbours only. df is read in each round: give a stored one."""
    slim = df.select(*by, key, position, a, b)
    left, found = slim, None
    for k in range(rounds):
        reach = most / 2 ** (rounds - 1 - k)
        s = left.select(*by, F.struct(key, position, a, b).alias("_a"), F.floor(F.col(position) / reach).alias("_bin"))
        t = slim.select(*by, F.struct(key, position, a, b).alias("_b"), F.explode(F.array(F.floor(F.col(position) / reach), F.floor(F.col(position) / reach) - 1)).alias("_bin"))
        d = F.col(f"_b.{position}") - F.col(f"_a.{position}")
        beside = (F.col(f"_a.{a}") < F.col(f"_b.{b}")) & (F.col(f"_b.{a}") < F.col(f"_a.{b}")) & (F.col(f"_a.{key}") != F.col(f"_b.{key}"))
        got = s.join(t, [*by, "_bin"]).where((d > least) & (d <= reach) & beside).groupBy(*by, F.col(f"_a.{key}").alias(key)).agg(F.min(d).alias("d")).checkpoint()
        found = got if found is None else found.unionByName(got)
        if k + 1 < rounds:
            left = left.join(got, [*by, key], "left_anti")
    return found


def lattice_members(left: DataFrame, right: DataFrame, by: list[str], lp: str, rp: str, spacing: float, tolerance: float) -> DataFrame:
    """Rows of left that lie a whole number of spacings, at least one, from a row of right (tolerance: a share of the spacing). Both meet in bins
    of their remainders, a little wider than the tolerance, the right side in the bins beside its own too."""
    n = int(0.95 / tolerance)
    bin_of = lambda c: F.least(F.floor(F.pmod(F.col(c), F.lit(spacing)) * n / spacing), F.lit(n - 1))
    a = left.withColumn("_bin", bin_of(lp))
    b = right.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(rp).alias("_p"), bin_of(rp).alias("_own")).distinct()
    b = b.withColumn("_beside", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("_own") + k, F.lit(n)) for k in (-1, 0, 1)]))))
    m = F.abs(F.col(lp) - F.col("_p")) / spacing
    on = (F.col("_bin") == F.col("_beside")) & (F.abs(m - F.rint(m)) <= tolerance) & (F.rint(m) >= 1)
    for c in by:
        on = on & (a[c] == F.col(f"_{c}"))
    return a.join(b, on, "left_semi").drop("_bin")


def interval_overlap(left: DataFrame, right: DataFrame, by: list[str], bin_width: float, la: str = "a", lb: str = "b", ra: str = "c", rb: str = "d") -> DataFrame:
    """Rows of both sides whose intervals overlap, with lo and hi of what they share. Intervals are dealt over bins, and a pair is kept in
    the first bin that both have."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_width), F.floor(F.col(b) / bin_width)))
    a = left.withColumn("_bin", bins(la, lb))
    b = right.withColumn("_bin", bins(ra, rb))
    lo, hi = F.greatest(la, ra), F.least(lb, rb)
    return a.join(b, [*by, "_bin"]).where((hi > lo) & (F.col("_bin") == F.floor(lo / bin_width))).withColumns({"lo": lo, "hi": hi}).drop("_bin")


def edges(vertices: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, x1, y1, x2, y2: the edges of closed rings given by their vertices in order."""
    w = Window.partitionBy(*by)
    nxt = lambda c: F.coalesce(F.lead(c).over(w.orderBy(order)), F.first(c).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return vertices.select(*by, F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))


def scanlines(edge: DataFrame, by: list[str], step: float = 1.0, offset: float = 0.0) -> DataFrame:
    """by, k, x1, x2: the pieces of the lines y = offset + k * step that lie inside the rings. Each edge is dealt to the lines that it
    crosses; crossings are paired in order, odd with even."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil((lo - offset) / step), F.ceil((hi - offset) / step) - 1  # an edge holds its lower end
    e = edge.where(F.col("y1") != F.col("y2")).withColumn("_k", F.when(first <= last, F.sequence(first, last)))
    c = e.select(*by, F.explode("_k").alias("k"), "x1", "y1", "x2", "y2")
    y = offset + F.col("k") * step
    c = c.select(*by, "k", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    w = Window.partitionBy(*by, "k").orderBy("x")
    c = c.withColumn("_n", F.row_number().over(w)).withColumn("x2", F.lead("x").over(w))
    return c.where("_n % 2 = 1 AND x2 IS NOT NULL").select(*by, "k", F.col("x").alias("x1"), "x2")


def cells_inside(pieces: DataFrame, by: list[str]) -> DataFrame:
    """by, r, c: the whole numbers inside the pieces of scanlines."""
    first, last = F.ceil("x1"), F.ceil("x2") - 1
    return pieces.withColumn("_c", F.when(first <= last, F.sequence(first, last))).select(*by, F.col("k").alias("r"), F.explode("_c").alias("c"))


def outline(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, r, c, side: the sides of cells that no cell of the same group lies beyond; four shifted copies and one anti-join."""
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for n, dr, dc in (("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1))])
    s = cells.withColumn("_s", F.explode(sides)).select(*by, "r", "c", "_s.side", (F.col("r") + F.col("_s.dr")).alias("_r"), (F.col("c") + F.col("_s.dc")).alias("_c"))
    other = cells.select(*by, F.col("r").alias("_r"), F.col("c").alias("_c")).distinct()
    return s.join(other, [*by, "_r", "_c"], "left_anti").select(*by, "r", "c", "side")
