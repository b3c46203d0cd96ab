"""Sinks: layers as Parquet, GeoJSON lines, CSV summaries, and a GeoPackage for small results."""

from __future__ import annotations

import sqlite3
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layers(folder: str, **frames: DataFrame | None) -> list[str]:
    """Writes each layer as Parquet in a folder of its own; layers that are None are left out."""
    done = []
    for name, df in frames.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            done.append(name)
    return done


def line_geometry(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    c = lambda a, b: F.array(F.col(a).cast("double"), F.col(b).cast("double"))
    return F.struct(F.lit("LineString").alias("type"), F.array(c(x1, y1), c(x2, y2)).alias("coordinates"))


def polygon_geometry(ring: str = "ring") -> Column:
    pts = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    closed = F.concat(pts, F.slice(pts, 1, 1))
    return F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))


def geojson(df: DataFrame, geometry: Column, path: str) -> None:
    """One GeoJSON feature per line, written by all tasks."""
    props = F.struct(*[F.col(c) for c, t in df.dtypes if not t.startswith(("array", "struct"))])
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("value")).write.mode("overwrite").text(path)


def csv_summary(df: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """One file with a header; one row per block, so it is small. Missing values are empty; decimals round half to even."""
    for c, n in (decimals or {}).items():
        df = df.withColumn(c, F.bround(c, n))
    df.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def optional(write, *args) -> str | None:
    """Runs the write of an optional layer; its failure is returned and doesn't touch the other layers."""
    try:
        write(*args)
    except Exception as e:  # noqa: BLE001  the error is the result
        return f"{type(e).__name__}: {e}"
    return None


def _wkb(kind: int, points: list[tuple[float, float]]) -> bytes:
    head = b"GP\x00\x01" + struct.pack("<i", -1)
    flat = b"".join(struct.pack("<dd", *p) for p in points)
    body = struct.pack("<BI", 1, kind) + (struct.pack("<I", 1) if kind == 3 else b"") + struct.pack("<I", len(points)) + flat
    return head + body


def geopackage(path: str, srs_id: int = -1, limit: int = 1_000_000, **frames: DataFrame) -> None:
    """Layers of lines (x1, y1, x2, y2) or polygons (ring) in one GeoPackage file. A file of this kind has one writer, so rows come to the driver
    partition by partition; more than `limit` rows are an error: write those with layers()."""
    with sqlite3.connect(path) as db:
        db.executescript(
            "PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;"
            "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);"
            "INSERT INTO gpkg_spatial_ref_sys VALUES ('undefined cartesian', -1, 'NONE', -1, 'undefined', NULL);"
            "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT DEFAULT '', last_change DATETIME DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);"
            "CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT);"
        )
        for name, df in frames.items():
            if df.limit(limit + 1).count() > limit:
                raise ValueError(f"{name} has more than {limit} rows; write it with layers()")
            polygon = "ring" in df.columns
            own = [c for c in df.columns if c not in ("x1", "y1", "x2", "y2", "ring")]
            kinds = {c: "REAL" if t in ("double", "float") else "INTEGER" if t in ("int", "bigint", "smallint", "boolean") else "TEXT" for c, t in df.dtypes}
            cols = "".join(f', "{c}" {kinds[c]}' for c in own)
            db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{cols})')
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, srs_id))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (name, "POLYGON" if polygon else "LINESTRING", srs_id))
            marks = ", ".join("?" for _ in own)
            for r in df.toLocalIterator():
                pts = [(p["x"], p["y"]) for p in r["ring"]] if polygon else [(r["x1"], r["y1"]), (r["x2"], r["y2"])]
                g = _wkb(3, [*pts, pts[0]]) if polygon else _wkb(2, pts)
                db.execute(f'INSERT INTO "{name}" (geom{"".join(f", {chr(34)}{c}{chr(34)}" for c in own)}) VALUES (?{", " + marks if own else ""})', (g, *[r[c] if not isinstance(r[c], bool) else int(r[c]) for c in own]))
