"""Means of few values are the sums in the order of the files, as in the SQL with one thread, however Spark splits these among tasks."""

from datetime import datetime, timedelta

import compare
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rowloom.operators import aggregate as A
from rowloom.plans import registry

DAY0 = datetime(2024, 1, 1)
#: One by one they make 135, a mean of 45; the first and the sum of the others, which another task reads, make more or less.
MORE, LESS = [4.52, 69.18, 61.3], [3.73, 75.21, 56.06]


def held(spark, out, name, days):
    """A query's rows, held against its SQL with one thread: a day's first value is in one file, the others are in a second one."""
    (out / "events.parquet").mkdir()
    for k, part in enumerate((slice(0, 1), slice(1, None))):
        rows = [{"ts": DAY0 + timedelta(days=i, hours=1), "user_id": 1, "value": x} for i, values in enumerate(days) for x in values[part]]
        pq.write_table(pa.Table.from_pylist(rows), out / "events.parquet" / f"part-{k}.parquet")
    con = compare.connected(str(out))
    con.execute("SET threads = 1")
    got = registry.QUERIES[name](spark, str(out)).toPandas()
    compare.same(got, con.execute(registry.ORACLE_SQL[name]).fetchdf())
    return got


def test_band_centre_in_file_order(spark, tmp_path):
    assert held(spark, tmp_path, "band_centre", [MORE] * 6)["own"].tolist() == [0]


def test_islands_in_file_order(spark, tmp_path):
    assert held(spark, tmp_path, "islands", [LESS] * 6 + [[44.0]])[["first", "last"]].values.tolist() == [[6, 6]]


def test_row_failures_in_file_order(spark, tmp_path):
    # The levels are 40 and 50, so days with a mean of 45 are at a half, not under it.
    assert held(spark, tmp_path, "row_failures", [[50.0]] * 3 + [LESS] * 10 + [[50.0]] * 3 + [[40.0]] * 5)[["first", "last"]].values.tolist() == [[16, 20]]


@pytest.mark.parametrize("few", [2, 3])
def test_ordered_means(spark, few):
    rows = [(None, 2, 69.18), (None, 1, 4.52), (None, 3, 61.3), (1, 1, 7.0), (1, 2, None), (2, 1, None)]
    df = spark.createDataFrame(rows, "k int, at int, x double").repartition(3)
    assert dict(map(tuple, A.ordered_means(df, ["k"], "x", "m", ["at"], few).collect())) == ({1: 7.0} if few < 3 else {1: 7.0, None: 45.0})
    assert dict(map(tuple, A.exact_means(df, ["k"], "x", "m", few, ["at"]).collect())) == {1: 7.0, 2: None, None: 45.0}
