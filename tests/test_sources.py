import json
import os
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.sources import rastertiles, sinks, vectors
from rowloom.streaming import failures as FS


def test_raster_tiles(spark, tmp_path):
    a = np.arange(5 * 40 * 50, dtype="float32").reshape(5, 40, 50)
    a[0, 3, 4] = np.nan
    a[4] = 255
    a[4, 0, :] = 0
    np.save(tmp_path / "x.npy", a)
    rastertiles.register(spark)
    df = spark.read.format("rastertiles").option("tile", 16).option("alpha", "true").load(f"{tmp_path}/x.npy")
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("valid").cast("int")).alias("v"), F.sum("nir").alias("s")).first()
    assert got["n"] == 2000 and got["v"] == 2000 - 50 - 1 and got["s"] == pytest.approx(float(a[3].sum(dtype="float64")))
    part = spark.read.format("rastertiles").option("tile", 16).option("r0", 10).option("r1", 20).option("c0", 45).load(f"{tmp_path}/x.npy")
    assert part.count() == 50 and part.rdd.getNumPartitions() == 4


def test_vectors(spark):
    lines = spark.createDataFrame([(1, [[(0.0, 0.0), (5.0, 5.0), (9.0, 1.0)], [(1.0, 1.0)]]), (2, None), (3, [])], "line_id long, parts array<array<struct<x:double,y:double>>>")
    assert [tuple(r) for r in vectors.segments(lines).collect()] == [(1, 0, 0.0, 0.0, 9.0, 1.0)]
    sq = [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 3.0)]
    polys = spark.createDataFrame([(5, sq, "2.5"), (4, sq, "-1"), (3, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], "1"), (6, sq, "x"), (7, None, "1")], "o int, ring array<struct<x:double,y:double>>, sp string")
    assert [(r.lot_id, r.area, r.spacing_m) for r in vectors.lots(polys, "o", spacing="sp").collect()] == [(1, 6.0, None), (2, 6.0, 2.5), (3, 6.0, None)]


def test_guards(spark):
    px = spark.createDataFrame([(1.0, 2.0, 3.0, True), (1.0, 9.0, 3.0, True)], "red double, green double, blue double, valid boolean")
    gt = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    assert vectors.checked_raster(px, gt) is px
    for bad in (lambda: vectors.checked_raster(px, gt, geographic=True), lambda: vectors.checked_raster(px.limit(0), gt), lambda: vectors.checked_raster(px.limit(1), gt), lambda: vectors.checked_raster(px.drop("red"), gt), lambda: vectors.checked_raster(px, (0.0, 1.0, 0.1, 0.0, 0.0, 1.0))):
        with pytest.raises(vectors.SourceError):
            bad()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 2.0, 2.125, None), (2, 1.0, 1.0, 3.0, 2.0, 0.375, "a")], "id int, x1 double, y1 double, x2 double, y2 double, len double, flag string")
    assert sinks.layers(f"{tmp_path}/l", rows=df, blocks=None) == ["rows"] and spark.read.parquet(f"{tmp_path}/l/rows").count() == 2
    sinks.geojson(df, sinks.line_geometry(), f"{tmp_path}/g")
    one = json.loads(spark.read.text(f"{tmp_path}/g").orderBy("value").first()[0])
    assert one["geometry"] == {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 2.0]]} and one["properties"]["id"] == 1
    sinks.csv_summary(df.select("id", "len", "flag"), f"{tmp_path}/c", {"len": 2})
    name = next(x for x in os.listdir(tmp_path / "c") if x.endswith(".csv"))
    assert (tmp_path / "c" / name).read_text().splitlines() == ["id,len,flag", "1,2.12,", "2,0.38,a"]
    sinks.geopackage(f"{tmp_path}/x.gpkg", rows=df)
    with sqlite3.connect(f"{tmp_path}/x.gpkg") as db:
        assert db.execute("SELECT count(*), sum(len) FROM rows").fetchone() == (2, 2.5)
        assert db.execute("SELECT table_name FROM gpkg_contents").fetchall() == [("rows",)]
    assert "Error" in sinks.optional(lambda: 1 / 0) and sinks.optional(lambda: None) is None


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, f"2024-01-01 {h:02d}:00:00", v) for u in (1, 2) for h, v in ((0, 1.0), (3, 2.0), (12, 3.0), (13, 99.0), (14, 4.0))] + [(9, "2024-03-01 00:00:00", 1.0)]
    ev = spark.createDataFrame(rows, "user_id long, t string, value double").select("user_id", F.to_timestamp("t").alias("ts"), "value")
    ev.write.parquet(f"{tmp_path}/in")
    s = FS.low_sessions(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in"), 50.0)
    FS.run_to_end(s, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("row_id", "start", "n").collect()}
    want = {tuple(r) for r in FS.low_sessions(ev, 50.0).select("row_id", "start", "n").collect() if r.row_id != 9}
    assert got == want and len(want) == 4
