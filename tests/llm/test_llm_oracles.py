"""The registered queries that SQL can express, on given tables."""

import os

import duckdb
import pytest

from rowloom.llm import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = registry.QUERIES[name](spark, FOLDER)
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert set(columns) <= set(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_hosts_reject_documents_that_pass_alone(spark):
    got = registry.QUERIES["quality_rules_by_kind"](spark, "/root/testdata/sf0.01").collect()
    rejected = [r for r in got if not r.base_failed and not r.kept]
    assert rejected and all(r.host_rate > 0.56 for r in rejected) and all(r.kept for r in got if not r.base_failed and r.host_rate < 0.2)
