import numpy as np
import pytest

from rowloom.operators import adjust, growth
from rowloom.sources import repair


def test_plants_prolong_and_join_but_a_lone_tree_does_not(spark):
    rows = spark.createDataFrame([(1, 0.0, 20.0, 4.0), (2, 0.0, 20.0, 4.0), (2, 34.0, 50.0, 4.0), (3, 0.0, 5.0, 4.0)], "row int, a double, b double, per double")
    plants = spark.createDataFrame([(1, 23.0, 24.0, 4.0), (1, 27.0, 28.0, 4.0), (1, 33.0, 34.0, 4.0), (2, 24.0, 25.0, 4.0), (4, 0.0, 6.0, 4.0), (4, 9.0, 13.0, 4.0), (5, 0.0, 6.0, 4.0)], "row int, a double, b double, per double")
    got = sorted(tuple(r) for r in growth.by_plants(rows, plants, ["row"]).select("row", "a", "b").collect())
    assert got == [(1, 0.0, 28.0), (2, 0.0, 50.0), (4, 0.0, 13.0)]
    assert growth.by_plants(rows.limit(0), plants.limit(0), ["row"]).count() == 0


def band(shift):
    u, d = (x.ravel() for x in np.meshgrid(np.arange(80) + 0.5, np.arange(-16, 16) * 0.5 + 0.25, indexing="ij"))
    return u, d, np.exp(-(((d - shift(u)) / 1.5) ** 2))


def test_rows_follow_their_plants():
    u, d, v = band(lambda u: 0.04 * np.maximum(u - 10, 0))
    knots, c, accepted, rounds, peaks = adjust.adjusted(u, d, v, 4.0, 5.0, 0.5, most=4.0)
    assert accepted and 1 <= rounds <= 3 and peaks == 20
    assert np.abs(adjust.polyline(u, knots, c) - 0.04 * np.maximum(u - 10, 0)).max() < 0.4
    held = adjust.adjusted(u, d, v, 4.0, 5.0, 0.5, most=0.5)
    assert np.abs(adjust.polyline(u, *held[:2])).max() <= 0.6


@pytest.mark.parametrize("shift", [lambda u: 0.8 - 1.6 * (np.floor(u / 4) % 2), lambda u: np.where(u < 60, 99.0, 0.0)])
def test_rows_without_a_better_line_stay(shift):
    knots, c, accepted, *_ = adjust.adjusted(*band(shift), 4.0, 5.0, 0.5)
    assert not accepted and knots == [] and not c.any()


def test_rings_are_repaired(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    cases = {
        "whole": (square, [16.0]),
        "closed": ([*square, square[0]], [16.0]),
        "spike": ([(0.0, 0.0), (4.0, 0.0), (9.0, 0.0), (7.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [16.0]),
        "spike at the seam": ([(-3.0, 0.0), *square[:1], *square[1:], (0.0, 0.0)], [16.0]),
        "bow tie": ([(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 2.0)], None),
        "line": ([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], []),
        "null": (None, []),
        "empty": ([], []),
    }
    df = spark.createDataFrame([(k, r) for k, (r, _) in cases.items()], "name string, ring array<struct<x:double,y:double>>")
    got = {r.name: [repair.area([tuple(p) for p in x]) for x in r.rings] for r in repair.repaired(df).select("name", "rings").collect()}
    for name, (_, areas) in cases.items():
        if areas is not None:
            assert got[name] == pytest.approx(areas), name
    # The lines y = x and y = 2 - x / 2 cross at 4 / 3.
    assert got["bow tie"] == pytest.approx([4 * (4 - 4 / 3) / 2, 2 * (4 / 3) / 2])
