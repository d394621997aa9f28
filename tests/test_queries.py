"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from sparkloom.plans import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "embeddings", "part", "supplier"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got.columns, got.collect()), normal(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=2e-5, rel_tol=1e-9) for p, q in zip(x, y, strict=True)), (x, y)


def test_queries_without_sql(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.SQL)):
        assert catalog.QUERIES[name](spark, DIR).count() > 0


def _inside(plan):
    yield plan
    below = plan.children()
    for p in [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [below.apply(i) for i in range(below.size())]:
        yield from _inside(p)


def test_no_exchange_carries_a_vector_for_each_edge(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = catalog.QUERIES["msg_degree_norm"](spark, DIR)._jdf.queryExecution().executedPlan()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [p.output().mkString(" ") for p in _inside(plan) if "Exchange" in p.nodeName()]
    assert moved and not any("h#" in m and "dst#" in m for m in moved), moved
