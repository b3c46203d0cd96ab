"""Readers of line and polygon tables, and their guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


class SourceError(ValueError):
    """An input that can't be used, and why."""


def segments(lines: DataFrame, id_column: str = "line_id", parts: str = "parts") -> DataFrame:
    """seg_id, part, x1, y1, x2, y2 of lines given as arrays of parts of points. Null and empty lines and parts of one point are left out; of
    each part only the first and the last point count."""
    p = lines.where(F.col(parts).isNotNull()).select(F.col(id_column).alias("seg_id"), F.posexplode(parts).alias("part", "_p")).where(F.size("_p") >= 2)
    a, b = F.element_at("_p", 1), F.element_at("_p", -1)
    return p.select("seg_id", "part", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def signed_area(ring: str):
    """Twice the area's half: the shoelace sum of a ring."""
    n = F.size(ring)
    nxt = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, x: s + x) / 2


def lots(polygons: DataFrame, order: str, ring: str = "ring", spacing: str | None = None) -> DataFrame:
    """lot_id (1, 2, ... in the order of a column), ring, area, spacing_m of polygons with an area; a spacing counts only if it is a positive
    number. Lots are few, so numbering them is one small task."""
    from pyspark.sql.window import Window

    p = polygons.where(F.col(ring).isNotNull() & (F.size(ring) >= 3)).withColumn("area", F.abs(signed_area(ring))).where("area > 0")
    s = F.expr(f"try_cast({spacing} AS double)") if spacing else F.lit(None).cast("double")
    return p.select(F.row_number().over(Window.orderBy(order)).alias("lot_id"), F.col(ring).alias("ring"), "area", F.when(s > 0, s).alias("spacing_m"))


def checked_raster(px: DataFrame, geotransform: tuple[float, ...], geographic: bool = False, rotated_ok: bool = False) -> DataFrame:
    """px, if its place and content can be used; else SourceError. Reads one aggregate."""
    if geographic:
        raise SourceError("coordinates must be projected metres")
    if not rotated_ok and (geotransform[2] or geotransform[4]):
        raise SourceError("the raster is rotated")
    missing = {"red", "green", "blue", "valid"} - set(px.columns)
    if missing:
        raise SourceError(f"bands are missing: {', '.join(sorted(missing))}")
    exg = (2 * F.col("green") - F.col("red") - F.col("blue")) / (F.col("red") + F.col("green") + F.col("blue") + 1e-6)
    g = px.where("valid").agg(F.count(F.lit(1)).alias("n"), (F.percentile(exg, F.lit(0.995)) - F.percentile(exg, F.lit(0.005))).alias("spread")).first()
    if not g["n"]:
        raise SourceError("no valid pixel")
    if g["spread"] < 1e-6:
        raise SourceError("the raster is uniform")
    return px
