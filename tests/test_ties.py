"""Equal intervals at the start of a run: each is counted in its run, and rows of a union don't overlap. The SQL sorts twice and leaves ties
open, so rows are held against plain code here."""

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rowloom.plans import registry

DAY0 = datetime(1992, 1, 1)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Supplier 7, three times over, has runs that begin with equal intervals, a day behind the end before, between two pieces."""
    out = tmp_path_factory.mktemp("ties")
    spans = [(110, 25), (110, 25), (112, 5), (116, 20), (116, 20), (140, 50), (145, 25), (151, 5), (151, 5), (151, 10)] * 3
    rows = [{"l_orderkey": k, "l_partkey": 3, "l_suppkey": 7, "l_quantity": float(q), "l_returnflag": "N", "l_shipdate": DAY0 + timedelta(days=a)} for k, (a, q) in enumerate(spans)]
    pq.write_table(pa.Table.from_pylist(rows), out / "lineitem.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array([7], pa.int64())}), out / "supplier.parquet")
    return str(out), [(float(a), a + q / 5) for a, q in spans]


def union(intervals, gap):
    rows = []
    for a, b in sorted(intervals):
        if rows and a - rows[-1][1] <= gap:
            rows[-1] = (rows[-1][0], max(rows[-1][1], b), rows[-1][2] + 1)
        else:
            rows.append((a, b, 1))
    return rows


def got(spark, name, folder, *columns):
    return sorted(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, folder).collect())


def test_interval_union_of_equal_intervals(spark, folder):
    out, spans = folder
    pieces = [(200.0 * k + 7, 200.0 * k + 97) for k in range(13)]
    assert got(spark, "interval_union", out, "a", "b", "n") == union(spans + pieces, 0)


def test_merge_intervals_of_equal_intervals(spark, folder):
    out, spans = folder
    assert got(spark, "merge_intervals", out, "a", "b", "n") == union(spans, 1)


def test_plant_sequences_of_equal_intervals(spark, folder):
    out, spans = folder
    assert got(spark, "plant_sequences", out, "a", "b") == [(a, b) for a, b, _ in union(spans, 2.4 * 4) if b - a >= 12] == [(140.0, 153.0)]
