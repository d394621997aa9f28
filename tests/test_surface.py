"""The SQL surface: what it refuses, that slices change nothing, that conditions reach the scans."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sparkloom.graph import PropertyGraph
from sparkloom.operators.sampling import expand
from sparkloom.plans import surface


@pytest.fixture(scope="module")
def graph(spark):
    edges = spark.range(900).select((F.col("id") * 7 % 50).alias("src"), (F.col("id") * F.col("id") % 13).alias("dst")).distinct()
    nodes = spark.range(50).select(F.col("id").alias("node_id"), F.when(F.col("id") != 3, F.array(F.col("id").cast("double"), F.lit(1.0))).alias("features"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("target"))
    found = PropertyGraph(nodes, edges.where("src <> dst"))
    surface.register(spark, found, "small", 2)
    return found


@pytest.mark.parametrize("call", ["sample_neighbours(TABLE(small_edges), 0, 1, 1)", "sample_neighbours(TABLE(small_nodes), 2, 1, 1)", "sample_neighbours(3, 2, 1, 1)", "sample_neighbours(TABLE(small_edges), 2, 1, 1, 0)", "check_batches(TABLE(small_edges), 3)"])
def test_odd_calls_are_refused(spark, graph, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM {call}").collect()


@pytest.mark.parametrize("slices", [1, 3])
def test_samples_are_those_of_the_operator(spark, graph, slices):
    want = sorted(map(tuple, expand(graph.view(), graph.nodes, 4, 2, 9).select("dst", "src").collect()))
    inner = f"SELECT dst, src FROM sample_neighbours(TABLE(small_edges), 4, 9, 2, {slices})"
    got = spark.sql(f"SELECT dst, src FROM sample_neighbours(TABLE({inner}), 4, 9, 2)" if slices > 1 else inner).collect()
    assert sorted(map(tuple, got)) == want


def test_fetch_fills_what_is_absent(spark, graph):
    rows = {r.node_id: (r.features, r.target) for r in spark.sql("SELECT * FROM small_fetch()").collect()}
    assert rows[3] == ([0.0, 0.0], -1) and rows[4] == ([4.0, 1.0], 4) and len(rows) == 50


def test_conditions_reach_the_edges(spark, graph):
    plan = spark.sql("SELECT * FROM small_mean() WHERE node_id = 5")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("= 5") >= 3


def test_no_odd_names(spark, graph):
    with pytest.raises(ValueError):
        surface.register(spark, graph, "a; drop", 2)


def test_empty_tables(spark, graph):
    assert spark.sql("SELECT * FROM sample_neighbours(TABLE(SELECT * FROM small_edges WHERE src < 0), 2, 1, 1)").collect() == []
