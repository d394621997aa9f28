"""Graphs and logs over the driver's tables, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.lineage import scratch
from sparkloom.graph import PropertyGraph, ingest_edges
from sparkloom.sources.layout import store_graph

#: Features have this many dimensions.
DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("vec_id") % 10
    split = F.when(turn < 6, "train").when(turn < 8, "val").otherwise("test")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("features"), F.col("label").alias("target"), split.alias("split"))


def raw_edges(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'") if sparse else table(spark, sf_dir, "lineitem")
    pairs = rows.select((F.col("l_partkey") % n).cast("long").alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % n).cast("long").alias("dst"))
    return pairs.where("src <> dst")


def graph(spark: SparkSession, sf_dir: str, sparse: bool = False) -> PropertyGraph:
    """Edges are a set; their ends exist by construction."""
    return PropertyGraph(nodes(spark, sf_dir), raw_edges(spark, sf_dir, sparse).distinct())


_stored: dict[tuple, PropertyGraph] = {}


def stored(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph in buckets, stored once in a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stored:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        where = scratch(spark, "graph")
        _stored[key] = store_graph(graph(spark, sf_dir), "graph_" + where.rpartition("-")[2], where, buckets)
    return _stored[key]


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_edges(nodes(spark, sf_dir), raw_edges(spark, sf_dir))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("node_id % 25 = 0").select("node_id")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, event, time, value); time in seconds since the first of 2020."""
    time = F.timestamp_diff("MICROSECOND", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 1e6
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("event"), time.alias("time"), "value")


CTES = {
    "nodes": """nodes AS (SELECT vec_id AS node_id, embedding AS features, label AS target,
  CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM embeddings)""",
    "g1": """g1 AS (SELECT DISTINCT CAST(l_partkey % n AS BIGINT) AS src, CAST((l_suppkey * 7 + l_orderkey) % n AS BIGINT) AS dst
  FROM lineitem, (SELECT count(*) AS n FROM embeddings) WHERE l_partkey % n <> (l_suppkey * 7 + l_orderkey) % n)""",
    "g2": """g2 AS (SELECT DISTINCT CAST(l_partkey % n AS BIGINT) AS src, CAST((l_suppkey * 7 + l_orderkey) % n AS BIGINT) AS dst
  FROM lineitem, (SELECT count(*) AS n FROM embeddings) WHERE l_partkey % n <> (l_suppkey * 7 + l_orderkey) % n AND l_returnflag = 'R')""",
    "seeds": "seeds AS (SELECT vec_id AS node_id FROM embeddings WHERE vec_id % 25 = 0)",
    "x": "x AS (SELECT vec_id AS node_id, CAST(d - 1 AS BIGINT) AS dim, CAST(embedding[d] AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) t(d))",
    "deg1": "deg1 AS (SELECT vec_id AS node_id, count(src) AS d FROM embeddings LEFT JOIN g1 ON dst = vec_id GROUP BY vec_id)",
    "deg2": "deg2 AS (SELECT vec_id AS node_id, count(src) AS d FROM embeddings LEFT JOIN g2 ON dst = vec_id GROUP BY vec_id)",
    "und1": "und1 AS (SELECT src, dst FROM g1 UNION SELECT dst, src FROM g1)",
    "und2": "und2 AS (SELECT src, dst FROM g2 UNION SELECT dst, src FROM g2)",
    "log": "log AS (SELECT event_id, user_id, event_type AS event, (epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01 00:00:00')) / 1e6 AS time, value FROM events)",
}


def sql(names: str, body: str, *more: str) -> str:
    """WITH the named definitions and further ones."""
    return "WITH " + ",\n".join([*(CTES[n] for n in names.split()), *more]) + "\n" + body
