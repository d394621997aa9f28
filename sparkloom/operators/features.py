"""Feature and label gathering, label codes, hot sets and caches."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut
from sparkloom.graph import PropertyGraph
from sparkloom.operators.aggregate import gcn_norm
from sparkloom.operators.sampling import SEED, dense_index, fanout


def fetch(requests: DataFrame, nodes: DataFrame, *, features: bool = True, labels: bool = True) -> DataFrame:
    """(pos, node_id, features, target): missing nodes, and nodes without features where those are asked for, are dropped; order and repeats of the requests stay."""
    have = nodes.where(F.col("features").isNotNull()) if features else nodes
    cols = ["node_id", *(["features"] if features else []), *(["target"] if labels else [])]
    return requests.join(have.select(*cols), "node_id").select("pos", *cols)


def gather(requests: DataFrame, nodes: DataFrame, dim: int, missing_label: int = -1) -> DataFrame:
    """Dense batch in request order: zeros and `missing_label` for what is missing."""
    zeros = F.array(*[F.lit(0.0)] * dim)
    out = requests.join(nodes.select("node_id", "features", "target"), "node_id", "left")
    return out.select("pos", "node_id", F.coalesce(F.col("features").cast("array<double>"), zeros).alias("h"), F.coalesce(F.col("target").cast("long"), F.lit(missing_label)).alias("target"))


def gather_cached(requests: DataFrame, hot: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """gather() with a flag for the requests that a hot set(node_id) answers."""
    flags = hot.select("node_id").distinct().withColumn("hit", F.lit(True))
    return gather(requests, nodes, dim).join(flags, "node_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def hybrid_bundle(nodes: DataFrame, frontier: DataFrame, aggregated: DataFrame, dim: int) -> DataFrame:
    """(node_id, h, preagg): raw vectors, zeros for the frontier, with the pre-aggregated vectors of the targets."""
    edge = frontier.select("node_id").distinct().withColumn("__edge", F.lit(True))
    zeros = F.array(*[F.lit(0.0)] * dim)
    out = nodes.select("node_id", F.col("features").cast("array<double>").alias("h")).join(edge, "node_id", "left")
    return out.select("node_id", F.when(F.col("__edge"), zeros).otherwise(F.col("h")).alias("h")).join(aggregated.select("node_id", F.col("h").alias("preagg")), "node_id", "left")


def sampled_bundle(graph: PropertyGraph, seeds: DataFrame, fanouts: list[int], dim: int, missing_label: int = -1, seed: int = SEED) -> DataFrame:
    """(node_id, hop, degree, x, preagg, target) of the nodes of a sample: what a model needs whose first layer is aggregated beforehand.

    degree counts sampled edges; x is the raw vector, zeros if absent; preagg is the
    normalised sum over the sampled edges into the node, for nodes above the last hop
    that have a vector, else null; target is the label.
    """
    nodes, edges = fanout(graph, seeds, fanouts, seed=seed)
    nodes, edges = cut(nodes), cut(edges)
    counted = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("degree"))
    known = cut(nodes.join(counted, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    x = graph.nodes.where(F.col("features").isNotNull()).select("node_id", F.col("features").cast("array<double>").alias("h"))
    inner = nodes.where(F.col("hop") < len(fanouts)).select("node_id")
    pre = gcn_norm(edges, x.join(nodes.select("node_id"), "node_id", "left_semi"), known.select("node_id", "degree"), inner, dim)
    raw = gather(known.select(F.col("node_id").alias("pos"), "node_id"), graph.nodes, dim, missing_label)
    out = known.join(raw.select("node_id", F.col("h").alias("x"), "target"), "node_id").join(pre.withColumnRenamed("h", "preagg"), "node_id", "left")
    return out.select("node_id", "hop", "degree", "x", "preagg", "target")


def encode_labels(nodes: DataFrame, column: str = "target") -> DataFrame:
    """(node_id, code): dense codes of the sorted distinct labels; null is -1. The distinct labels are numbered, not the rows."""
    codes = dense_index(nodes.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("label")).distinct(), "label").select("label", F.col("local_id").alias("code"))
    return nodes.select("node_id", F.col(column).cast("string").alias("label")).join(codes, "label", "left").select("node_id", F.coalesce("code", F.lit(-1)).cast("long").alias("code"))


def encode_labels_seen(nodes: DataFrame, order: str, column: str = "target") -> DataFrame:
    """(node_id, code): dense codes in the order in which labels first occur by `order`, ties by label; null is -1."""
    rows = nodes.select("node_id", order, F.col(column).cast("string").alias("label"))
    first = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(order).alias("first"))
    codes = dense_index(first, "first", "label").select("label", F.col("local_id").alias("code"))
    return rows.select("node_id", "label").join(codes, "label", "left").select("node_id", F.coalesce("code", F.lit(-1)).cast("long").alias("code"))


def top_out_degree(graph: PropertyGraph, k: int) -> DataFrame:
    """The k nodes with features of most out-edges; ties by id."""
    counted = graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    have = graph.nodes.where(F.col("features").isNotNull()).select("node_id")
    return counted.join(have, "node_id", "left_semi").orderBy(F.col("degree").desc(), "node_id").limit(k)


def pagerank(graph: PropertyGraph, rounds: int = 20, damping: float = 0.85, checkpoint_every: int = 5) -> DataFrame:
    """(node_id, rank) on the undirected graph: (1 - d) + d sum PR(u) / deg(u), a fixed number of rounds.

    Lineage is cut by a reliable checkpoint every few rounds.
    """
    view = graph.view("undirected")
    degree = view.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    # links are computed once and dealt by src, as every round joins them on it
    links = cut(view.join(degree.withColumnRenamed("node_id", "src"), "src").select("src", "dst", "degree").repartition("src"))
    rank = graph.nodes.select("node_id", F.lit(1.0).alias("rank"))
    for i in range(1, rounds + 1):
        sent = links.join(rank.withColumnRenamed("node_id", "src"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("s"))
        rank = graph.nodes.select("node_id").join(sent, "node_id", "left").select("node_id", (F.lit(1 - damping) + F.lit(damping) * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if i % checkpoint_every == 0 and i < rounds:
            rank = cut(rank)
    return rank


def cache_capacity(size_bytes: int, dim: int, label_bytes: int = 8) -> int:
    """Entries of 4-byte floats (and a label, unless 0) that fit."""
    return size_bytes // (4 * dim + label_bytes)


def hit_summary(requests: DataFrame, hot: DataFrame) -> DataFrame:
    """(hits, misses, hit_rate) of a static hot set over all requests."""
    flags = requests.select("node_id").join(hot.select("node_id").distinct().withColumn("h", F.lit(1)), "node_id", "left")
    return flags.agg(F.count("h").alias("hits"), (F.count("*") - F.count("h")).alias("misses"), (F.count("h") / F.count("*")).alias("hit_rate"))


def lru(requests: DataFrame, capacity: int, cache: str = "cache_id", order: str = "pos") -> DataFrame:
    """(cache_id, pos, node_id, hit) of an LRU cache of `capacity` entries for each cache's stream of requests, replayed in order, ties by id.

    The replay is sequential by nature: one group for each cache, streamed in
    Arrow batches, with state no larger than the cache.
    """

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: OrderedDict[int, None] = OrderedDict()
        current = None
        for frame in frames:
            hits = []
            for c, n in zip(frame[cache].tolist(), frame["node_id"].tolist(), strict=True):
                if c != current:
                    state.clear()
                    current = c
                hits.append(n in state)
                state[n] = None
                state.move_to_end(n)
                if len(state) > capacity:
                    state.popitem(last=False)
            yield frame.assign(hit=hits)

    dealt = requests.select(cache, order, "node_id").repartition(cache).sortWithinPartitions(cache, order, "node_id")
    return dealt.mapInPandas(replay, f"{cache} long, {order} long, node_id long, hit boolean")


def tiered(requests: DataFrame, *tiers: DataFrame) -> DataFrame:
    """(pos, node_id, tier): the first tier that holds each request; null if none does."""
    out, found = requests, []
    for i, t in enumerate(tiers):
        out = out.join(t.select("node_id").distinct().withColumn(f"__t{i}", F.lit(i)), "node_id", "left")
        found.append(F.col(f"__t{i}"))
    return out.select("pos", "node_id", F.coalesce(*found).alias("tier"))


def partition_ids(nodes: DataFrame, parts: int) -> DataFrame:
    """(node_id, part) by id."""
    return nodes.select("node_id", F.pmod("node_id", F.lit(parts)).alias("part"))


def propagate_labels(graph: PropertyGraph, parts: int, rounds: int = 3) -> DataFrame:
    """Partition ids that follow the neighbours' most frequent one, ties to the least; a start by id."""
    now = partition_ids(graph.nodes, parts)
    view = cut(graph.view("undirected"))
    best = Window.partitionBy("dst").orderBy(F.col("n").desc(), "part")
    for _ in range(rounds):
        votes = view.join(now.withColumnRenamed("node_id", "src"), "src").groupBy("dst", "part").agg(F.count("*").alias("n"))
        won = votes.withColumn("rn", F.row_number().over(best)).where("rn = 1").select(F.col("dst").alias("node_id"), F.col("part").alias("won"))
        # a round's votes and its rest both read the ids of the round before
        now = cut(now.join(won, "node_id", "left").select("node_id", F.coalesce("won", "part").alias("part")))
    return now


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(cut, edges, balance): undirected pairs across parts, and the largest part over the mean."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    sides = pairs.join(parts.select(F.col("node_id").alias("a"), F.col("part").alias("pa")), "a").join(parts.select(F.col("node_id").alias("b"), F.col("part").alias("pb")), "b")
    crossing = sides.agg(F.count(F.when(F.col("pa") != F.col("pb"), 1)).alias("cut"), F.count("*").alias("edges"))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n")).agg((F.max("n") / F.avg("n")).alias("balance"))
    return crossing.join(sizes)
