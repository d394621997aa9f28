"""Property graphs as two tables.

nodes(node_id, features, target, split, ...) and edges(src, dst, ...). Edges are a
set; direction is src -> dst, and a node's in-neighbours are the src of its edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    def view(self, direction: str = "incoming") -> DataFrame:
        """(dst, src): centre and neighbour, by direction. In `undirected` a pair counts once from either end, without self-loops."""
        e = self.edges.select("src", "dst")
        swapped = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if direction == "incoming":
            return e
        if direction == "outgoing":
            return swapped
        if direction == "undirected":
            return e.unionByName(swapped).where("src <> dst").distinct()
        raise ValueError(f"no such direction: {direction}")

    def degrees(self, direction: str = "incoming", neighbor_label: str | None = None, only: DataFrame | None = None) -> DataFrame:
        """(node_id, degree) of every node, or of those in only(node_id); 0 without edges."""
        view, nodes = self.view(direction), self.nodes.select("node_id")
        if only is not None:
            ids = only.select("node_id").distinct()
            view = view.join(ids.select(F.col("node_id").alias("dst")), "dst", "left_semi")
            nodes = nodes.join(ids, "node_id", "left_semi")
        if neighbor_label is not None:
            view = view.join(self.nodes.where(F.col("label") == neighbor_label).select(F.col("node_id").alias("src")), "src", "left_semi")
        counted = view.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n"))
        return nodes.join(counted, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))

    def resolved_degrees(self, stored: str | None = None, only: DataFrame | None = None) -> DataFrame:
        """Degrees from a stored numeric property where there is one, else counted."""
        counted = self.degrees(only=only)
        if stored is None or stored not in self.nodes.columns:
            return counted
        own = self.nodes.select("node_id", F.expr(f"try_cast(`{stored}` AS bigint)").alias("own"))
        return counted.join(own, "node_id").select("node_id", F.coalesce("own", "degree").alias("degree"))

    def induced(self, members: DataFrame) -> PropertyGraph:
        """The subgraph of the nodes in members(node_id); isolated ones stay."""
        ids = members.select("node_id").distinct()
        edges = self.edges.join(ids.select(F.col("node_id").alias("src")), "src", "left_semi").join(ids.select(F.col("node_id").alias("dst")), "dst", "left_semi")
        return PropertyGraph(self.nodes.join(ids, "node_id", "left_semi"), edges.select("src", "dst"))


def disagreement(a: PropertyGraph, b: PropertyGraph) -> DataFrame:
    """(kind, only_a, only_b): nodes and edges of one graph that the other lacks, repeats counted; all zero where the graphs agree."""

    def apart(kind: str, x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.withColumn("__n", F.lit(1)).unionByName(y.withColumn("__n", F.lit(-1)))
        left = both.groupBy(*x.columns).agg(F.sum("__n").alias("n"))
        more = lambda c: F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0)).cast("long")
        return left.agg(more(F.col("n")).alias("only_a"), more(-F.col("n")).alias("only_b")).select(F.lit(kind).alias("kind"), "only_a", "only_b")

    return apart("nodes", a.nodes.select("node_id"), b.nodes.select("node_id")).unionByName(apart("edges", a.edges.select("src", "dst"), b.edges.select("src", "dst")))


def upsert_nodes(current: DataFrame, batch: DataFrame, key: str = "node_id", version: str = "version") -> DataFrame:
    """Rows by key, the one of highest version winning; later tables win ties."""
    rows = current.withColumn("__turn", F.lit(0)).unionByName(batch.withColumn("__turn", F.lit(1)))
    columns = [c for c in current.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(version), F.col("__turn"))).alias("row"))
    return newest.select(key, *[F.col(f"row.{c}").alias(c) for c in columns])


def ingest_edges(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """Distinct edges whose ends both exist."""
    ids = nodes.select("node_id")
    kept = raw.join(ids.select(F.col("node_id").alias("src")), "src", "left_semi").join(ids.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return kept.select("src", "dst").distinct()
