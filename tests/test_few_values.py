"""Means of few values, without copies, are those of the SQL: exact ones fall on the other side of a threshold."""

from datetime import datetime, timedelta

import compare
import pytest

from rowloom.plans import registry

DAY0 = datetime(2024, 1, 1)


def write(spark, out, days):
    rows = [(DAY0 + timedelta(days=i, seconds=k), user, x) for user, all_ in days.items() for i, values in enumerate(all_) for k, x in enumerate(values)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, value double").coalesce(1).write.parquet(f"{out}/events.parquet")


def held(spark, out, name):
    con = compare.connected(str(out))
    con.execute("SET threads = 1")
    got = registry.QUERIES[name](spark, str(out)).toPandas()
    compare.same(got, con.execute(registry.ORACLE_SQL[name]).fetchdf())
    return got


@pytest.mark.parametrize("high, low, large", [([98.44, 118.77, 64.5], [59.5, 35.97, 180.24], 0.0), ([43.26, 111.1, 72.46], [52.33, 25.66, 142.83], 1.0)])
def test_sign_alternation_of_few_values(spark, tmp_path, high, low, large):
    # Two apart; by plain sums, in any order, a little less or not.
    write(spark, tmp_path, {1: [high, low] * 6})
    assert held(spark, tmp_path, "sign_alternation")["large"].tolist() == [large]


def test_band_centre_of_few_values(spark, tmp_path):
    # The exact mean is 45; that of the sums in the order of the file is more.
    write(spark, tmp_path, {1: [[55.17, 78.25, 1.58]] * 6})
    assert held(spark, tmp_path, "band_centre")["own"].tolist() == [6]


def test_copies_of_many_stay_exact(spark, tmp_path):
    write(spark, tmp_path, {1: [[44.99, 44.9, 45.11] * 60, [43.0]] * 6})
    assert [tuple(r) for r in registry.QUERIES["sign_alternation"](spark, str(tmp_path)).collect()] == [(1, 11, 1.0, 1.0)]
