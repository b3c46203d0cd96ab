"""Queries that take the whole table, against plain code and counts of the tables."""

import os

import duckdb
import pytest

from rowloom.plans import registry
from rowloom.sources import scenes

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def rows(sql):
    return duckdb.sql(sql).fetchall()


def test_interval_union_takes_every_interval_and_piece(spark):
    got = registry.QUERIES["interval_union"](spark, FOLDER).collect()
    own = rows(f"SELECT l_suppkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE AS a, a + l_quantity / 5 FROM '{FOLDER}/lineitem.parquet'")
    pieces = [(s, 200.0 * k + s, 200.0 * k + s + 90) for (s,) in rows(f"SELECT s_suppkey FROM '{FOLDER}/supplier.parquet'") for k in range(13)]
    want = []
    for row, a, b in sorted(own + pieces):
        if want and want[-1][0] == row and a <= want[-1][2]:
            want[-1][2:] = [max(want[-1][2], b), want[-1][3] + 1]
        else:
            want.append([row, a, b, 1])
    assert sorted((r.row_id, r.a, r.b, r.n) for r in got) == sorted((r, a, round(b, 6), n) for r, a, b, n in want)
    assert sum(r.n for r in got) == len(own) + len(pieces) and max(r.b for r in got) > 3000


def test_every_whole_tile_has_a_spectrum(spark):
    got = registry.QUERIES["tile_spectrum"](spark, FOLDER).collect()
    assert sorted(r.tile for r in got) == list(range(rows(f"SELECT count(*) FROM '{FOLDER}/embeddings.parquet'")[0][0] // 16))


def test_a_tile_with_a_missing_row_has_none(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT * FROM '{FOLDER}/embeddings.parquet' WHERE vec_id < 70 AND vec_id <> 20) TO '{tmp_path}/embeddings.parquet'")
    assert sorted(r.tile for r in registry.QUERIES["tile_spectrum"](spark, str(tmp_path)).collect()) == [0, 2, 3]


def test_rounding_takes_every_part(spark):
    assert registry.QUERIES["rounding"](spark, FOLDER).count() == rows(f"SELECT count(*) FROM '{FOLDER}/part.parquet'")[0][0]


def test_failures_of_all_rows_are_those_of_the_scene(spark):
    got = [(r.lot, r.row_id, r.first, r.first + r.length) for r in registry.QUERIES["failures_by_lot"](spark, FOLDER).collect()]
    true = {(lot, row, a, b) for lot in (0, 1) for row, a, b in scenes.truth(spark)}
    assert len(got) == len(set(got)) and set(got) <= true and (1, -3, 70, 95) in got
    assert {x for x in true if x[1] >= 0} <= set(got)
