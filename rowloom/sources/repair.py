"""Repair of polygons: repeated points, spikes, and rings that cross themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]


def _spike(a: Point, b: Point, c: Point) -> bool:
    """Whether b is a tip: the way from a to b goes back on itself to c."""
    x1, y1, x2, y2 = b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]
    along = x1 * x2 + y1 * y2
    return along < 0 and abs(x1 * y2 - y1 * x2) <= 1e-12 * abs(along)


def tidy(ring: list[Point]) -> list[Point]:
    """The ring without repeated points and spikes."""
    out: list[Point] = []
    for q in ring:
        while len(out) >= 2 and out[-1] != q and _spike(out[-2], out[-1], q):
            out.pop()
        if not out or out[-1] != q:
            out.append(q)
    while len(out) >= 2:
        if out[0] == out[-1] or (len(out) >= 3 and _spike(out[-2], out[-1], out[0])):
            out.pop()
        elif len(out) >= 3 and _spike(out[-1], out[0], out[1]):
            out.pop(0)
        else:
            break
    return out


def area(ring: list[Point]) -> float:
    p = np.array(ring, float).reshape(-1, 2)
    p = p - p.mean(0) if len(p) else p
    q = np.roll(p, -1, 0)
    return abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2


def _crossed(ring: list[Point]) -> list[Point]:
    """The ring with the points at which it meets itself, each in both of its places."""
    p = np.array(ring, float)
    q = np.roll(p, -1, 0)
    way = q - p
    more: dict[int, list[tuple[float, Point]]] = {}
    for i in range(len(p) - 2):
        j = np.arange(i + 2, len(p) - (i == 0))
        det = way[i, 0] * way[j, 1] - way[i, 1] * way[j, 0]
        gap = p[j] - p[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * way[j, 1] - gap[:, 1] * way[j, 0]) / det
            s = (gap[:, 0] * way[i, 1] - gap[:, 1] * way[i, 0]) / det
        for k in np.flatnonzero((det != 0) & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1)):
            ends = {0.0: p[i], 1.0: q[i]}.get(float(t[k]), {0.0: p[j[k]], 1.0: q[j[k]]}.get(float(s[k]), p[i] + t[k] * way[i]))
            at = (float(ends[0]), float(ends[1]))
            more.setdefault(i, []).append((float(t[k]), at))
            more.setdefault(int(j[k]), []).append((float(s[k]), at))
    out: list[Point] = []
    for i, start in enumerate(ring):
        out += [start, *[at for _, at in sorted(more.get(i, []))]]
    return [x for k, x in enumerate(out) if k == 0 or x != out[k - 1]]


def _inside(point: Point, ring: list[Point]) -> bool:
    x, y = point
    p = np.array(ring, float)
    q = np.roll(p, -1, 0)
    over = (p[:, 1] > y) != (q[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = p[:, 0] + (y - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0])
    return bool((over & (x < at)).sum() % 2)


def simple_rings(ring: list[Point]) -> list[list[Point]]:
    """The simple rings that a ring consists of, the largest first. It is cut where it meets itself; a part within another one is a hole and is
    left out, as are parts without an area."""
    walk = tidy([x for x in ring if np.isfinite(x).all()])
    if len(walk) < 3:
        return []
    seen: dict[Point, int] = {}
    way: list[Point] = []
    found = []
    for x in _crossed(walk):
        if x in seen:
            found.append(way[seen[x] :])
            for y in way[seen[x] + 1 :]:
                del seen[y]
            way = way[: seen[x] + 1]
        else:
            seen[x] = len(way)
            way.append(x)
    found = [y for y in (tidy(x) for x in [*found, way]) if len(y) >= 3 and area(y) > 0]
    middle = lambda r: ((r[0][0] + r[1][0]) / 2, (r[0][1] + r[1][1]) / 2)
    outer = [x for x in found if sum(_inside(middle(x), y) for y in found if y is not x) % 2 == 0]
    return sorted(outer, key=area, reverse=True)


def _rings(x: pd.Series, y: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(x, y):
        ring = [] if a is None else [(float(p), float(q)) for p, q in zip(a, b) if p is not None and q is not None]
        out.append([[k for point in r for k in point] for r in simple_rings(ring)])
    return pd.Series(out)


def repaired(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """polygons with `rings`, the simple rings of each (S11): of a null ring, or one without an area, none; of one that is in order, itself.
    Polygons are few and one is a value of one row, so its points fit a task."""
    flat = F.pandas_udf(_rings, "array<array<double>>")(F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"]))
    point = lambda r, i: F.struct(F.get(r, 2 * i).alias("x"), F.get(r, 2 * i + 1).alias("y"))
    return polygons.withColumn("rings", F.transform(flat, lambda r: F.transform(F.sequence(F.lit(0), (F.size(r) / 2).cast("int") - 1), lambda i: point(r, i))))
