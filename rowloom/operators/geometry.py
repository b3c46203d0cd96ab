"""Rings and lines: outlines of components, simplification, buffers, stepped rings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.operators.ordered import schema_of

RING = "ring array<struct<x:double,y:double>>"


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The points of a line that are needed to stay within a tolerance of it (farthest point first, with a stack and no recursion)."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = points[a + 1 : b], points[b] - points[a]
        n = np.hypot(*d)
        off = np.abs(d[0] * (p[:, 1] - points[a, 1]) - d[1] * (p[:, 0] - points[a, 0])) / n if n else np.hypot(*(p - points[a]).T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def outline(cells: set[tuple[int, int]]) -> list[tuple[float, float]]:
    """The outer ring of connected cells (r, c), as corners (x, y), clockwise on the screen."""
    step = {}
    for r, c in cells:
        for (dr, dc), a, b in (((-1, 0), (c, r), (c + 1, r)), ((0, 1), (c + 1, r), (c + 1, r + 1)), ((1, 0), (c + 1, r + 1), (c, r + 1)), ((0, -1), (c, r + 1), (c, r))):
            if (r + dr, c + dc) not in cells:
                step.setdefault(a, []).append(b)
    best: list = []
    while step:
        start = min(step)
        ring, at, before = [start], start, (0, 0)
        while True:
            options = step[at]
            # Where two rings touch, turn right, so that they stay apart.
            turn = lambda b: ((b[0] - at[0]) * before[1] - (b[1] - at[1]) * before[0])  # noqa: B023, E731
            nxt = min(options, key=turn) if len(options) > 1 and before != (0, 0) else options[0]
            options.remove(nxt)
            if not options:
                del step[at]
            before, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
            if at == start:
                break
            ring.append(at)
        if len(ring) > len(best):
            best = ring
    return best


def component_rings(cells: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """by, ring, area: the outer ring of each component of cells (r, c), simplified. A component is one group; its cells should be at work
    resolution, so that it fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = outline(set(zip(pdf["r"].tolist(), pdf["c"].tolist())))
        p = np.array([*ring, ring[0]], float)
        s = simplified(p, tolerance)[:-1]
        area = 0.5 * abs(np.dot(s[:, 0], np.roll(s[:, 1], -1)) - np.dot(s[:, 1], np.roll(s[:, 0], -1)))
        return pdf[by].head(1).assign(ring=[[{"x": x, "y": y} for x, y in s.tolist()]], area=float(area))

    return cells.groupBy(*by).applyInPandas(run, schema_of(cells, by, RING + ", area double"))


def line_buffer(x1: str, y1: str, x2: str, y2: str, half: float | Column) -> Column:
    """The rectangle around a line, with flat ends."""
    h = half if isinstance(half, Column) else F.lit(float(half))
    dx, dy = F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)
    n = F.sqrt(dx * dx + dy * dy)
    ox, oy = -dy / F.when(n > 0, n) * h, dx / F.when(n > 0, n) * h
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b, c, d = F.col(x1), F.col(y1), F.col(x2), F.col(y2)
    return F.array(p(a + ox, b + oy), p(c + ox, d + oy), p(c - ox, d - oy), p(a - ox, b - oy))


def stepped_ring(rows: DataFrame, by: list[str], v: str = "v", lo: str = "lo", hi: str = "hi", margin: float = 0.0) -> DataFrame:
    """by, ring: rows as strips from the middle to the row before to the middle to the row after, put together as one ring in (u, v): up along
    the low ends and back along the high ends; the outer strips are `margin` wider."""
    w = Window.partitionBy(*by).orderBy(v)
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    near = F.coalesce(after - F.col(v), F.col(v) - before, F.lit(0.0))
    r = rows.select(*by, v, lo, hi, F.coalesce((F.col(v) + before) / 2, F.col(v) - near / 2 - margin).alias("_a"), F.coalesce((F.col(v) + after) / 2, F.col(v) + near / 2 + margin).alias("_b"))
    pt = lambda u, y: F.struct(F.col(u).alias("x"), F.col(y).alias("y"))
    g = r.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(v).alias("v"), F.array(pt(lo, "_a"), pt(lo, "_b")).alias("l"), F.array(pt(hi, "_b"), pt(hi, "_a")).alias("h")))).alias("_r"))
    up, down = F.flatten(F.transform("_r", lambda x: x["l"])), F.flatten(F.reverse(F.transform("_r", lambda x: x["h"])))
    return g.select(*by, F.concat(up, down).alias("ring"))
