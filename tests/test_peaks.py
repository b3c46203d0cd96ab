import pytest

from rowloom.operators import peaks


def test_half_height_centres_beside_flat_valleys(spark):
    profiles = {1: [0, 0, 0, 0, 50, 100, 50, 0, 0, 0, 0], 2: [20, 20, 20, 20, 20, 255, 90, 60, 20, 20, 20], 3: [7] * 11}
    rows = [(r, c, float(v), 5) for r, p in profiles.items() for c, v in enumerate(p)]
    got = dict(map(tuple, peaks.half_height_centers(spark.createDataFrame(rows, "r int, c int, v double, k int"), ["r"], "c", "v", "k", 6.0).collect()))
    # The level of the second is 137.5, between 20 and 255 on the left and between 255 and 90 on the right.
    assert got == {1: 5.0, 2: pytest.approx((4 + 117.5 / 235 + 5 + 117.5 / 165) / 2), 3: None}
