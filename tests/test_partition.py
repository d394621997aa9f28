"""Balanced partitions: capacities hold, and clusters are found."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import partition


@pytest.fixture(scope="module")
def clusters(spark):
    # four rings of ids that share no remainder, each well joined, and a few edges between them
    inner = spark.range(200).select(F.col("id"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 5)])).alias("k")).select(F.col("id").alias("src"), (F.floor(F.col("id") / 50) * 50 + (F.col("id") + F.col("k")) % 50).cast("long").alias("dst"), F.lit(2).alias("weight"))
    across = spark.range(0, 200, 10).select(F.col("id").alias("src"), ((F.col("id") + 53) % 200).alias("dst"), F.lit(1).alias("weight"))
    one = inner.unionByName(across).distinct()
    return spark.range(200).select(F.col("id").alias("node_id")), one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).distinct()


def test_rounds_cut_less_and_stay_balanced(clusters):
    nodes, pairs = clusters
    start = partition.weighted_cut(pairs, partition.balanced_parts(nodes, pairs, 4, 0)).first()
    end = partition.weighted_cut(pairs, partition.balanced_parts(nodes, pairs, 4, 8)).first()
    assert end["cut"] < 0.75 * start["cut"] and end["total"] == start["total"] and end["balance"] <= 1.06 + 1e-9


def test_every_node_has_one_part(clusters):
    nodes, pairs = clusters
    rows = partition.balanced_parts(nodes, pairs, 7, 2).collect()
    assert len(rows) == len({r.node_id for r in rows}) == 200 and {r.part for r in rows} <= set(range(7))
    assert partition.balanced_parts(nodes.limit(0), pairs, 3, 1).collect() == []


def test_odd_arguments(clusters):
    with pytest.raises(ValueError):
        partition.balanced_parts(*clusters, 0)
    with pytest.raises(ValueError):
        partition.balanced_parts(*clusters, 2, slack=99)
