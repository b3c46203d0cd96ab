"""Connected components of cells and of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_dir(df: DataFrame) -> None:
    """checkpoint() needs a folder: the session's, or one of our own where it has none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="rowloom-"))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, comp: the least node of each component. Labels take the least of their neighbours and then that label's own label
    (pointer jumping), so the number of rounds grows with the logarithm of a chain's length."""
    shared_dir(nodes)
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct().checkpoint()
    now = nodes.select("node", F.col("node").alias("comp")).checkpoint()
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        new = now.join(near, "node", "left").select("node", "comp", F.least("comp", "low").alias("new"))
        hop = new.select(F.col("node").alias("new"), F.col("new").alias("far"))
        new = new.join(hop, "new").select("node", "comp", F.least("new", "far").alias("new")).checkpoint()
        changed = new.where("new < comp").limit(1).count()
        now = new.select("node", F.col("new").alias("comp"))
        if not changed:
            return now


def cell_components(cells: DataFrame, by: tuple[str, ...] = (), width: int = 1 << 20) -> DataFrame:
    """by, r, c, comp: 8-connected components of cells. A cell meets the four neighbours that come after it."""
    c = cells.select(*by, "r", "c", (F.col("r") * width + F.col("c")).alias("node"))
    later = F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    step = c.select(*by, F.col("node").alias("a"), F.explode(later).alias("n")).select(*by, "a", "n.r", "n.c")
    links = step.join(c.select(*by, "r", "c", F.col("node").alias("b")), [*by, "r", "c"])
    if by:  # nodes of different groups must not meet: make them distinct
        key = F.struct(*by, "a")
        links = links.select(F.to_json(key).alias("a"), F.to_json(F.struct(*by, F.col("b").alias("a"))).alias("b"))
        nodes = c.select(*by, "r", "c", F.to_json(F.struct(*by, F.col("node").alias("a"))).alias("node"))
    else:
        nodes = c
    return nodes.join(components(links, nodes), "node").select(*by, "r", "c", "comp")
