"""Tables with many copies of their rows: means, thresholds and runs stay as they are, whatever the order of addition."""

import math
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest

from rowloom.operators import aggregate as A
from rowloom.plans import registry

DAY0 = datetime(2024, 1, 1)
COPIES = 60


def write(spark, out, days):
    rows = [(DAY0 + timedelta(days=i, hours=1), user, x) for user, all_ in days.items() for i, values in enumerate(all_) for x in values]
    spark.createDataFrame(rows * COPIES, "ts timestamp, user_id long, value double").coalesce(1).write.parquet(f"{out}/events.parquet")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of two users. User 1's means are 45, 44, 50, 45, 45 and 20, by three values or more a day but the last; plain sums of their copies
    aren't. User 2's are 43 and 45 in turn."""
    days = {1: [[44.31, 44.93, 45.76], [43.9, 44.0, 44.1], [49.9, 50.0, 50.1], [44.7, 45.0, 45.3], [44.9, 44.95, 45.15], [20.0]], 2: [[42.7, 43.0, 43.3], [44.31, 44.93, 45.76]] * 6}
    out = str(tmp_path_factory.mktemp("repeats"))
    write(spark, out, days)
    return out


def test_exact_means_are_rounded_once(spark):
    rng = np.random.default_rng(3)
    groups = [list(rng.uniform(-100, 100, n).round(2)) for n in (1, 2, 3, 7, 400)] + [list(rng.normal(0, 10.0**e, 9)) for e in (-9, -3, 0, 9, 14, 25)] + [[0.1] * 60, [0.0, -0.0], [1e15, 0.3, -1e15], [math.inf, 1.0], [None, 4.5]]
    rows = [(k, x) for k, values in enumerate(groups) for x in values]
    df = spark.createDataFrame([(k, None if x is None else float(x)) for k, x in rows] + [(99, None)], "k int, x double")
    got = dict(map(tuple, A.exact_means(df, ["k"], "x", "m").collect()))
    for k, values in enumerate(groups):
        known = [float(x) for x in values if x is not None]
        if max(map(abs, known)) == math.inf:
            assert got[k] == math.inf
        elif 2.0**-12 <= max(map(abs, known)) < 2.0**50:
            assert got[k] == float(sum(map(Fraction, known)) / len(known)), k
        else:
            assert got[k] == pytest.approx(math.fsum(known) / len(known), rel=1e-12), k
    assert got[99] is None
    for n, order in ((1, -1), (60, 1), (7, -1)):
        again = spark.createDataFrame([(k, float(x)) for k, x in rows[::order] if x is not None and 4 >= k] * n, "k int, x double").repartition(3)
        assert dict(map(tuple, A.exact_means(again, ["k"], "x", "m").collect())) == {k: got[k] for k in range(5)}


def test_gap_fill_of_copies(spark, folder):
    got = sorted((r.row_id, r.first, r.last, r.n) for r in registry.QUERIES["gap_fill"](spark, folder).collect())
    assert got == [(1, 1, 1, 1), (1, 5, 5, 1), (2, 0, 10, 6)]


def test_sign_alternation_of_copies(spark, tmp_path):
    # Means are 45 and 43 in turn, so each step is large.
    write(spark, tmp_path, {1: [[44.99, 44.9, 45.11], [43.0]] * 6})
    assert [tuple(r) for r in registry.QUERIES["sign_alternation"](spark, str(tmp_path)).collect()] == [(1, 11, 1.0, 1.0)]


def test_band_centre_of_copies(spark, folder):
    # A mean of 45 is not over 45: user 1 has one day that is, and the days 0 and 3 of the band.
    got = sorted((r.row_id, r.own, r.band, r.moved) for r in registry.QUERIES["band_centre"](spark, folder).collect())
    assert got == [(1, 1, 3, True), (2, 0, 4, True)]


def test_islands_of_copies(spark, folder):
    got = sorted((r.row_id, r.first, r.last, r.n) for r in registry.QUERIES["islands"](spark, folder).collect())
    assert got == [(1, 1, 1, 1), (1, 5, 5, 1)] + [(2, i, i, 1) for i in range(0, 12, 2)]


def test_row_failures_of_copies(spark, tmp_path):
    # The levels are 40 and 50, so days with a mean of 45 are at a half, not under it.
    write(spark, tmp_path, {1: [[50.0]] * 3 + [[44.99, 44.9, 45.11]] * 10 + [[50.0]] * 3 + [[40.0]] * 5})
    assert [tuple(r) for r in registry.QUERIES["row_failures"](spark, str(tmp_path)).collect()] == [(1, 16, 20, 5, 0.0, 1)]
