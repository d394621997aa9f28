"""Graphs stored in buckets: hops don't move the edges, and other sessions can attach them."""

import pytest
from pyspark.sql import functions as F

from sparkloom.graph import PropertyGraph
from sparkloom.operators.sampling import expand, fanout
from sparkloom.sources import layout


@pytest.fixture(scope="module")
def graphs(spark, tmp_path_factory):
    nodes = spark.range(200).select(F.col("id").alias("node_id"), F.col("id").cast("double").alias("x"))
    edges = spark.range(3000).select((F.col("id") * 17 % 200).alias("src"), (F.col("id") * F.col("id") % 199).alias("dst")).where("src <> dst").distinct()
    plain = PropertyGraph(nodes, edges)
    where = str(tmp_path_factory.mktemp("stored"))
    return plain, layout.store_graph(plain, "kept", where, 4), where


def exchanges(frame) -> int:
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("direction", ["incoming", "outgoing"])
def test_a_hop_moves_the_frontier_only(spark, graphs, direction):
    plain, stored, _ = graphs
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        frontier = plain.nodes.where("node_id % 3 = 0").repartition(3)
        dealt = exchanges(frontier)
        assert exchanges(expand(stored.view(direction), frontier, 4, 1)) == dealt + 1
        assert exchanges(expand(plain.view(direction), frontier, 4, 1)) > dealt + 1
        assert exchanges(stored.degrees()) == 0 < exchanges(plain.degrees())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("direction", ["incoming", "outgoing", "undirected"])
def test_samples_are_the_same(graphs, direction):
    plain, stored, _ = graphs
    seeds = plain.nodes.where("node_id < 9")
    a, b = (sorted(map(tuple, fanout(g, seeds, [3, 2], direction=direction)[1].collect())) for g in (plain, stored))
    assert a == b and len(a) > 20


def test_other_sessions_attach_it(spark, graphs):
    plain, _, where = graphs
    other = spark.newSession()
    found = layout.attach_graph(other, "seen_again", where, 4)
    assert found.edges.count() == plain.edges.count() and exchanges(found.degrees()) <= 1
    with pytest.raises(ValueError):
        layout.attach_graph(other, "a b", where, 4)
    with pytest.raises(ValueError):
        layout.store_graph(plain, "none", where, 0)
