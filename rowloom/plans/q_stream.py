"""Streaming: beyond the inventory, the same failures from a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.plans.catalog import query
from rowloom.sources import standins as S
from rowloom.streaming import failures as FS


@query("""WITH low AS (SELECT user_id, ts, value FROM events WHERE value < 45), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM low WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
  SELECT user_id AS row_id, min(ts) AS start, count(*) AS n, round(avg(value), 6) AS level FROM s GROUP BY user_id, run""")
def low_sessions(spark, sf_dir):
    """Sessions of low values per row; the plan is the one that streams use."""
    return FS.low_sessions(S.read(spark, sf_dir, "events"), 45.0).select("row_id", "start", "n", F.round("level", 6).alias("level"))
