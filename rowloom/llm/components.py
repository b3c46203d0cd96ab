"""Connected components of a table of links, by large-star and small-star steps.

Each step is an aggregate per node and a join back, so a node with very many links is dealt over many
tasks by partial aggregation and the skew join. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import dropped, stored


def _least(directed: DataFrame) -> DataFrame:
    """For each u: the least of u and its neighbours."""
    return directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, comp (the least node of its component) for all nodes that have a link to another."""
    now = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "links")
    for _ in range(rounds):
        new = stored(_small_star(_large_star(now).where("a != b").distinct()).distinct(), "links")
        # A fixpoint: all links go straight to the least node, and no node has two.
        left = new.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() + new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        dropped(now)
        now = new
        if not left:
            break
    else:
        raise RuntimeError("components: no fixpoint")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
