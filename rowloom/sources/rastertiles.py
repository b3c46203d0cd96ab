"""A Spark data source for rasters stored as NumPy arrays: format("rastertiles").

The path is a .npy file of shape (bands, rows, columns), or (bands + 1, ...) with a last band of validity if the option `alpha` is true. One
input partition per tile; a tile is read through a memory map, so a task touches its own rows only. Options: tile (side, 256),
alpha (false), valid_above (0: what the validity band must exceed), nodata (a red value that is invalid), r0, r1, c0, c1 (a
window; only its tiles are planned). The file must be readable by all executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "tile_y int, tile_x int, r long, c long, red double, green double, blue double, nir double, valid boolean"


class Tile(InputPartition):
    def __init__(self, y: int, x: int, r0: int, r1: int, c0: int, c1: int):
        self.y, self.x, self.r0, self.r1, self.c0, self.c1 = y, x, r0, r1, c0, c1


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("tile", 256))
        self.alpha = str(options.get("alpha", "false")).lower() == "true"
        self.above = float(options.get("valid_above", 0))
        self.nodata = float(options["nodata"]) if "nodata" in options else None
        self.window = {k: int(options[k]) for k in ("r0", "r1", "c0", "c1") if k in options}
        a = np.load(self.path, mmap_mode="r")
        if a.ndim != 3 or a.shape[0] - self.alpha < 3:
            raise ValueError("a raster needs three bands at least, as (bands, rows, columns)")
        self.bands, self.rows, self.cols = a.shape

    def partitions(self) -> list[InputPartition]:
        w, n = self.window, self.size
        r0, r1 = max(0, w.get("r0", 0)), min(self.rows, w.get("r1", self.rows))
        c0, c1 = max(0, w.get("c0", 0)), min(self.cols, w.get("c1", self.cols))
        return [Tile(y, x, max(r0, y * n), min(r1, y * n + n), max(c0, x * n), min(c1, x * n + n)) for y in range(r0 // n, -(-r1 // n)) for x in range(c0 // n, -(-c1 // n)) if r1 > r0 and c1 > c0]

    def read(self, tile: Tile) -> Iterator:
        import pyarrow as pa

        a = np.load(self.path, mmap_mode="r")[:, tile.r0 : tile.r1, tile.c0 : tile.c1].astype(float)
        bands = a[: self.bands - self.alpha]
        ok = np.isfinite(bands[:3]).all(0)
        if self.alpha:
            ok &= a[-1] > self.above
        if self.nodata is not None:
            ok &= bands[0] != self.nodata
        r, c = np.indices(ok.shape)
        clean = lambda b: pa.array(np.where(np.isfinite(b), b, 0.0).ravel())
        nir = clean(bands[3]) if len(bands) > 3 else pa.nulls(ok.size, pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(ok.size, tile.y, np.int32)), pa.array(np.full(ok.size, tile.x, np.int32)), pa.array((r + tile.r0).ravel().astype(np.int64)), pa.array((c + tile.c0).ravel().astype(np.int64)), *(clean(b) for b in bands[:3]), nir, pa.array(ok.ravel())],
            names=["tile_y", "tile_x", "r", "c", "red", "green", "blue", "nir", "valid"],
        )


class RasterTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rastertiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterTiles)
