"""Queries of rows that grow and move."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import adjust, growth
from rowloom.plans.catalog import query
from rowloom.sources import standins as S


@query("""WITH x AS (SELECT l_partkey AS row_id, l_returnflag = 'N' AS own, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE AS a,
    date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE + l_quantity / 5 AS b FROM lineitem),
  p0 AS (SELECT *, max(b) OVER (PARTITION BY row_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM x WHERE NOT own),
  p1 AS (SELECT *, sum(CASE WHEN a - e <= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM p0),
  p AS (SELECT row_id, min(a) AS a, max(b) AS b FROM p1 GROUP BY row_id, g),
  k AS (SELECT row_id, a, b FROM x WHERE own UNION ALL
    SELECT row_id, a, b FROM p WHERE b - a >= 12 OR EXISTS (SELECT 1 FROM x o WHERE o.own AND o.row_id = p.row_id AND p.a - o.b <= 4 AND o.a - p.b <= 4)),
  m0 AS (SELECT *, max(b) OVER (PARTITION BY row_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM k),
  m1 AS (SELECT *, sum(CASE WHEN a - e <= 2.4::DOUBLE * 4 THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m0)
  SELECT row_id, min(a) AS a, round(max(b), 6) AS b FROM m1 GROUP BY row_id, g HAVING max(b) - min(a) >= 12""")
def plant_sequences(spark, sf_dir):
    """Intervals of rows, prolonged and joined by sequences of plants; a lone plant farther off is left out."""
    li = S.read(spark, sf_dir, "lineitem")
    a = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double")
    x = li.select(F.col("l_partkey").alias("row_id"), a.alias("a"), (a + F.col("l_quantity") / 5).alias("b"), F.lit(4.0).alias("per"), (F.col("l_returnflag") == "N").alias("own"))
    return growth.by_plants(x.where("own"), x.where("NOT own"), ["row_id"]).select("row_id", "a", F.round("b", 6).alias("b"))


@query("SELECT s_suppkey AS row_id, s_suppkey % 4 <> 3 AS accepted, true AS on_line FROM supplier")
def adjusted_rows(spark, sf_dir):
    """Rows that kink by two or four hundredths are followed to a third of a pixel; in one of four the plants stand to and fro, which no
    line with few kinks explains, so its first line stays. The SQL has the truth that the pixels are made from."""
    kink, slope = 8 + F.col("row_id") % 7, F.element_at(F.array(*[F.lit(x) for x in (-0.04, -0.02, 0.02, 0.04)]), (F.floor(F.col("row_id") / 4) % 4 + 1).cast("int"))
    truth = lambda u: F.when(F.col("row_id") % 4 == 3, 0.8 - 1.6 * (F.floor(u / 4) % 2)).otherwise(slope * F.greatest(u - kink, F.lit(0.0)))
    s = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"))
    px = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(79)))).withColumn("j", F.explode(F.sequence(F.lit(-16), F.lit(15))))
    px = px.select("row_id", (F.col("i") + 0.5).alias("u"), (F.col("j") * 0.5 + 0.25).alias("d")).withColumn("v", F.exp(-F.pow((F.col("d") - truth(F.col("u"))) / 1.5, 2)))
    o = adjust.adjust_rows(px, ["row_id"], "u", "d", "v", 4.0, 5.0, 0.5, most=4.0)
    line = lambda u: F.get("c", F.lit(0)) + F.get("c", F.lit(1)) * u + F.aggregate(F.zip_with("knots", F.slice("c", 3, 99), lambda k, x: x * F.greatest(u - k, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x)
    off = F.greatest(*[F.abs(line(F.lit(u)) - F.when(F.col("accepted"), truth(F.lit(u))).otherwise(0.0)) for u in (2.0, 20.0, 40.0, 60.0, 78.0)])
    return o.select("row_id", "accepted", (off <= 1 / 3).alias("on_line"))
