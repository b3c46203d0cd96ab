"""Forms that don't gather all values or all pairs, against plain code."""

import numpy as np
import pytest

from rowloom.operators import aggregate as A
from rowloom.operators import graph
from rowloom.operators import joins as J


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0, 1.0, 3.0], [2.0] * 50 + [9.0], "normal"])
def test_whole_levels_are_exact(spark, values):
    v = list(np.random.default_rng(5).normal(size=30_000).round(4)) if values == "normal" else values
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    got = A.whole_levels(df, "v", a=0.005, b=0.2, c=0.5, d=0.999, e=1.0).first()
    want = [None] * 5 if not v else [float(np.quantile(v, p)) for p in (0.005, 0.2, 0.5, 0.999, 1.0)]
    assert list(got) == (want if not v else pytest.approx(want, abs=1e-12))


def test_nearest_beside_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(int(g), k, float(x), float(y), float(y + h)) for k, (g, x, y, h) in enumerate(zip(rng.integers(0, 3, 400), rng.exponential(20, 400).round(1), rng.uniform(0, 50, 400), rng.uniform(0, 3, 400)))]
    df = spark.createDataFrame(rows, "g int, id long, x double, a double, b double")
    graph.shared_dir(df)
    want = {}
    for g, k, x, a, b in rows:
        d = [z - x for h, j, z, c, e in rows if h == g and j != k and 0.3 < z - x <= 8 and a < e and c < b]
        if d:
            want[g, k] = min(d)
    got = J.nearest_beside(df, ["g"], "x", 0.3, 8.0, "id", "a", "b").collect()
    assert len(got) == len(want) and {(r.g, r.id): r.d for r in got} == want


def test_lattice_members_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    left = [(k, int(g), float(v)) for k, (g, v) in enumerate(zip(rng.integers(0, 3, 300), rng.uniform(-900, 900, 300).round(1)))] + [(300, 0, 500.0), (301, 0, -0.5), (302, 1, None)]
    right = [(int(g), float(p)) for g, p in zip(rng.integers(0, 3, 12), rng.uniform(-900, 900, 12).round(1))] + [(0, 0.0), (0, 0.0), (1, None)]
    n = lambda v, p: abs(v - p) / 100
    want = {k for k, g, v in left if v is not None and any(h == g and p is not None and round(n(v, p)) >= 1 and abs(n(v, p) - round(n(v, p))) <= 0.02 for h, p in right)}
    a, b = spark.createDataFrame(left, "id long, lot int, v double"), spark.createDataFrame(right, "lot int, p double")
    got = [r.id for r in J.lattice_members(a, b, ["lot"], "v", "p", 100.0, 0.02).collect()]
    assert len(got) == len(set(got)) and set(got) == want
