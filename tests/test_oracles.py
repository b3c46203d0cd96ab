import os

import pytest
from compare import connected, same

from rowloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connected(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    same(registry.QUERIES[name](spark, FOLDER).toPandas(), con.execute(registry.ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_row_grouping_against_plain_code(spark, con):
    want = []
    for lot in range(25):
        own = [v for (v,) in con.execute(f"SELECT c_acctbal::DOUBLE FROM customer WHERE c_nationkey = {lot} ORDER BY c_acctbal").fetchall()]
        k, part = -1, []
        for v in own:
            if not part or v - sum(part) / len(part) > 60:
                k, part = k + 1, []
                want.append([lot, k, part])
            part.append(v)
    got = registry.QUERIES["row_grouping"](spark, FOLDER).collect()
    assert sorted((r.lot, r.group, r.n, round(r.v, 4)) for r in got) == sorted((lot, k, len(p), round(sum(p) / len(p), 4)) for lot, k, p in want)


def test_vote_clusters_against_plain_code(spark, con):
    gap = lambda x, y: min(abs(x - y) % 180, 180 - abs(x - y) % 180)
    votes = con.execute("SELECT p_brand, p_retailprice - 180.0::DOUBLE * floor(p_retailprice / 180.0::DOUBLE), p_size::DOUBLE, p_retailprice::DOUBLE FROM part WHERE p_retailprice >= 100 ORDER BY 1, 4 DESC, 2, 3").fetchall()
    sizes = {}
    for src in {v[0] for v in votes}:
        own = [v[1:] for v in votes if v[0] == src]
        founders = []
        for a, p, _ in own:
            if not any(gap(a, x) <= 15 and abs(p - y) <= 0.2 * y for x, y in founders):
                founders.append((a, p))
        of = [next(k for k, (x, y) in enumerate(founders) if gap(a, x) <= 15 and abs(p - y) <= 0.2 * y) for a, p, _ in own]
        sizes[src] = [of.count(k) for k in range(len(founders)) if of.count(k) >= 3]
    got = registry.QUERIES["vote_clusters"](spark, FOLDER).collect()
    assert got
    for src in sizes:
        mine = [r.n for r in got if r.src == src]
        # Harmonics are left out; what stays are some of the groups, the largest among them.
        assert all(mine.count(n) <= sizes[src].count(n) for n in mine) and (not sizes[src] or max(mine) == max(sizes[src]))


def test_cuts_and_ends_of_the_tables(spark):
    cuts = registry.QUERIES["cut_aligned_gaps"](spark, FOLDER).collect()
    assert all(r.n_rows >= 15 and abs(r.slope) <= 4 for r in cuts)
    ends = registry.QUERIES["regular_ends"](spark, FOLDER).collect()
    assert all(abs(r.lo - r.a) <= 24 and abs(r.hi - r.b) <= 24 + 1e-6 for r in ends)


def test_hinges_of_the_tables(spark):
    got = registry.QUERIES["hinge_fit"](spark, FOLDER).collect()
    assert all(r.kinks <= 2 for r in got) and all(r.accepted == (r.even_odd <= 0.85 * r.straight) or abs(r.even_odd - 0.85 * r.straight) < 1e-5 for r in got if r.even_odd == r.even_odd and r.even_odd is not None)
