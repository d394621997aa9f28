"""Graphs stored in buckets: nodes by id, edges by the end that is looked up, so that hops, gathers and degrees join without moving them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sparkloom.graph import PropertyGraph


def _check(name: str) -> None:
    if not re.fullmatch(r"[A-Za-z]\w*", name):
        raise ValueError(f"{name} is no name")


def _save(rows: DataFrame, table: str, path: str, key: str, then: list[str], buckets: int) -> None:
    # one file for each bucket: rows are dealt as the buckets are
    rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, *then).option("path", path).saveAsTable(table)


def store_graph(graph: PropertyGraph, name: str, path: str, buckets: int) -> PropertyGraph:
    """Write the graph below `path`, a folder that all executors see, and read it back.

    Tables name_nodes (by node_id), name_in (edges by dst) and name_out (by src) are
    registered in the session's catalogue. `buckets` of about 100 to 200 MB serve a
    large graph: they are the tasks of every hop over it.
    """
    _check(name)
    if buckets < 1:
        raise ValueError("a graph has one bucket at least")
    _save(graph.nodes, f"{name}_nodes", f"{path}/nodes", "node_id", [], buckets)
    _save(graph.edges, f"{name}_in", f"{path}/in", "dst", ["src"], buckets)
    _save(graph.edges, f"{name}_out", f"{path}/out", "src", ["dst"], buckets)
    return stored_graph(graph.nodes.sparkSession, name)


def attach_graph(spark: SparkSession, name: str, path: str, buckets: int) -> PropertyGraph:
    """Register a graph that another session has stored."""
    _check(name)
    for table, folder, key, then in (("nodes", "nodes", "node_id", ""), ("in", "in", "dst", ", src"), ("out", "out", "src", ", dst")):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{folder}").schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}{then}) INTO {buckets} BUCKETS LOCATION '{path}/{folder}'")
    return stored_graph(spark, name)


def stored_graph(spark: SparkSession, name: str) -> StoredGraph:
    return StoredGraph(spark.table(f"{name}_nodes"), spark.table(f"{name}_in"), spark.table(f"{name}_out"))


class StoredGraph(PropertyGraph):
    """Reads the edges from the copy that is dealt by the centre."""

    def __init__(self, nodes: DataFrame, incoming: DataFrame, outgoing: DataFrame):
        super().__init__(nodes, incoming)
        object.__setattr__(self, "outgoing", outgoing)

    def view(self, direction: str = "incoming") -> DataFrame:
        if direction == "outgoing":
            return PropertyGraph(self.nodes, self.outgoing).view(direction)
        return super().view(direction)
