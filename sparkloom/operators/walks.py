"""Random walks, and the global and layer-wise samplers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut
from sparkloom.functions.ordered import OrderedGroups
from sparkloom.functions.tape import tape, weighted_key
from sparkloom.graph import PropertyGraph
from sparkloom.operators.adjacency import Adjacency, pick, unit
from sparkloom.operators.sampling import SEED, dense_index, top_k


#: Steps of a walk that are planned together.
CUT = 4


def roots(nodes: DataFrame, n: int, seed: int = SEED, step: str = "root") -> DataFrame:
    """n random nodes."""
    return nodes.select("node_id").orderBy(tape(seed, step, "node_id"), "node_id").limit(n)


def walk(graph: PropertyGraph, start: DataFrame, length: int, *, seed: int = SEED, backtrack: bool = True, coalesce: bool = False, weight: Column | None = None) -> DataFrame:
    """(walker, step, node_id) over incoming edges; a walker without a next node stays.

    backtrack=False forbids going back to the node before. coalesce=True lets all
    walkers on a node take the same step. weight (a column over src, dst) biases
    the choice.
    """
    view = graph.view().select(F.col("dst").alias("at"), F.col("src").alias("to"), *([weight.alias("w")] if weight is not None else []))
    now = start.select(F.col("node_id").alias("walker"), F.col("node_id").alias("at"), F.lit(None).cast("long").alias("prev"))
    steps = now.select("walker", F.lit(0).alias("step"), F.col("at").alias("node_id"))
    for s in range(1, length + 1):
        key = tape(seed, s, "at", "to") if coalesce else tape(seed, s, "walker", "to")
        order = weighted_key(key, F.col("w")) if weight is not None else key
        open_to = order.isNotNull() & F.col("to").isNotNull()
        if not backtrack:
            open_to &= F.col("prev").isNull() | (F.col("to") != F.col("prev"))
        # one join and one aggregation carry a walker on; what it needs later travels as its key
        best = F.min(F.when(open_to, F.struct(order.alias("key"), F.col("to").alias("to"))))["to"]
        moved = now.join(view, "at", "left").groupBy("walker", "at", "prev").agg(best.alias("to"))
        now = moved.select("walker", F.coalesce("to", "at").alias("at"), F.when(F.col("to").isNotNull(), F.col("at")).otherwise(F.col("prev")).alias("prev"))
        # a few steps make one plan, whose exchanges are shared; longer walks are cut, so that plans grow in line with them
        now = cut(now) if s % CUT == 0 and s < length else now
        steps = steps.unionByName(now.select("walker", F.lit(s).alias("step"), F.col("at").alias("node_id")))
    return steps


def visit_counts(walks: list[DataFrame]) -> DataFrame:
    """(root, node_id, visits) over several walks, without the roots themselves."""
    every = None
    for w in walks:
        rows = w.where("step > 0 AND node_id <> walker")
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy(F.col("walker").alias("root"), "node_id").agg(F.count("*").alias("visits"))


def most_visited(counts: DataFrame, k: int) -> DataFrame:
    """The k most visited nodes of each root; ties by id."""
    return top_k(counts, ["root"], k, F.col("visits").desc(), F.col("node_id"))


def weighted_nodes(weights: DataFrame, k: int, *, seed: int = SEED, step: str = "w", mode: str = "exponential") -> DataFrame:
    """k nodes of weights(node_id, weight) without replacement."""
    keyed = weights.withColumn("key", weighted_key(tape(seed, step, "node_id"), F.col("weight"), mode)).where(F.col("key").isNotNull())
    return keyed.orderBy("key", "node_id").limit(k).select("node_id")


def weighted_edges(weights: DataFrame, k: int, *, seed: int = SEED, mode: str = "exponential") -> DataFrame:
    keyed = weights.withColumn("key", weighted_key(tape(seed, "e", "src", "dst"), F.col("weight"), mode)).where(F.col("key").isNotNull())
    return keyed.orderBy("key", "src", "dst").limit(k).select("src", "dst")


def uniform_edges(graph: PropertyGraph, k: int, seed: int = SEED) -> DataFrame:
    return graph.edges.select("src", "dst").orderBy(tape(seed, "ue", "src", "dst"), "src", "dst").limit(k)


def layer_dependent(graph: PropertyGraph, seeds: DataFrame, sizes: list[int], seed: int = SEED) -> DataFrame:
    """(layer, node_id): each layer draws neighbours of the one before by adjacency mass, the sum of 1 / in-degree of the centres they feed."""
    inverse = graph.degrees().where("degree > 0").select(F.col("node_id").alias("dst"), (1.0 / F.col("degree")).alias("mass"))
    layer, out = seeds.select("node_id").distinct(), seeds.select(F.lit(0).alias("layer"), "node_id").distinct()
    for i, k in enumerate(sizes, 1):
        mass = graph.view().join(layer.select(F.col("node_id").alias("dst")), "dst").join(inverse, "dst").groupBy(F.col("src").alias("node_id")).agg(F.round(F.sum("mass"), 9).alias("weight"))
        layer = weighted_nodes(mass, k, seed=seed, step=f"l{i}")
        out = out.unionByName(layer.select(F.lit(i).alias("layer"), "node_id"))
    return out


def edge_importance(graph: PropertyGraph) -> DataFrame:
    """(src, dst, weight) with weight 1 / deg(src) + 1 / deg(dst) over incoming degrees of at least 1."""
    d = graph.degrees().select("node_id", F.greatest("degree", F.lit(1)).alias("degree"))
    e = graph.edges.join(d.select(F.col("node_id").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("node_id").alias("dst"), F.col("degree").alias("b")), "dst")
    return e.select("src", "dst", (1.0 / F.col("a") + 1.0 / F.col("b")).alias("weight"))


def cluster_members(nodes: DataFrame, clusters: int, chosen: int, seed: int = SEED) -> DataFrame:
    """Members of a random subset of stored clusters (cluster_id column, or id modulo `clusters`)."""
    own = nodes if "cluster_id" in nodes.columns else nodes.withColumn("cluster_id", F.pmod("node_id", F.lit(clusters)))
    picked = own.select("cluster_id").distinct().orderBy(tape(seed, "c", "cluster_id")).limit(chosen)
    return own.join(picked, "cluster_id", "left_semi").select("node_id", "cluster_id")


#: Samples of the pilot, and how much more than the pilot suggests is drawn.
PILOT, MARGIN = 16, 1.25


def root_draws(nodes: DataFrame, samples: DataFrame, batch: int, seed: int) -> DataFrame:
    """(sample, node_id): for each of samples(sample) `batch` different random nodes, all if there are no more.

    Nodes are numbered once; a sample draws 4 batch + 32 numbers and keeps the first
    different ones. Where the nodes are fewer than four batches, each sample orders
    them all instead, which is no more rows.
    """
    index = cut(dense_index(nodes.select("node_id"), "node_id").select("local_id", "node_id"))
    n = index.count()
    if n < 4 * batch:
        drawn = samples.withColumn("local_id", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))))).withColumn("turn", tape(seed, "cover", "sample", "local_id"))
        drawn = drawn if n else drawn.limit(0)
    else:
        drawn = samples.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(4 * batch + 32))))
        drawn = drawn.withColumn("local_id", pick(unit(tape(seed, "cover", "sample", "turn")), F.lit(n))).groupBy("sample", "local_id").agg(F.min("turn").alias("turn"))
    first = top_k(drawn.withColumn("local_id", F.col("local_id").cast("long")), ["sample"], batch, F.col("turn"), F.col("local_id"))
    return first.join(index, "local_id").select("sample", "node_id")


def sampled_walks(adjacency: Adjacency, nodes: DataFrame, samples: DataFrame, batch: int, length: int, seed: int) -> DataFrame:
    """(sample, node_id): the different nodes of coalescing walks from each sample's roots. Walkers of a sample that meet go on as one."""
    now = cut(adjacency.located(root_draws(nodes, samples, batch, seed).withColumnRenamed("node_id", "at"), "at"))
    seen = now.select("sample", F.col("at").alias("node_id"))
    slots = adjacency.slots.select(F.col("node").alias("at"), "slot", "to", F.col("degree").alias("onward"))
    for s in range(1, length + 1):
        drawn = now.withColumn("slot", pick(unit(tape(seed, s, "sample", "at")), F.col("degree")))
        moved = drawn.join(slots, ["at", "slot"], "left")
        now = cut(moved.select("sample", F.coalesce("to", "at").alias("at"), F.coalesce("onward", "degree").alias("degree")).distinct())
        seen = seen.unionByName(now.select("sample", F.col("at").alias("node_id")))
    return cut(seen.distinct())


def covering_samples(graph: PropertyGraph, batch: int, length: int, coverage: float = 1.0, seed: int = SEED) -> DataFrame:
    """(sample, node_id): distinct nodes of coalescing walks from `batch` random roots, the first samples whose sizes add up to `coverage` times the nodes.

    All samples are drawn in one plan. Their number comes from a pilot of PILOT
    samples; should its margin not do, as many are drawn as do in any case, since a
    sample holds its roots at least. So there are three rounds at most, at any size.
    """
    n = graph.nodes.count()
    if not n:
        return graph.nodes.select(F.lit(0).cast("long").alias("sample"), "node_id").limit(0)
    needed, adjacency = n * coverage, Adjacency.of(graph)
    enough = max(1, math.ceil(needed / min(batch, n)))
    numbered = lambda to: graph.nodes.sparkSession.range(to).withColumnRenamed("id", "sample")
    count = min(PILOT, enough)
    while True:
        members = sampled_walks(adjacency, graph.nodes, numbered(count), batch, length, seed)
        sizes = members.groupBy("sample").agg(F.count("*").alias("n"))
        drawn = sizes.agg(F.sum("n")).first()[0]
        if drawn >= needed or count == enough:
            break
        count = min(enough, math.ceil(needed / drawn * count * MARGIN) + 4) if count == PILOT else enough
    upto = OrderedGroups(sizes, [], ["sample"]).running(total=F.col("n"))
    kept = upto.where(F.col("total") - F.col("n") < needed).select("sample")
    return members.join(kept, "sample", "left_semi")


def node_norm(nodes: DataFrame, samples: DataFrame, n_samples: int) -> DataFrame:
    """(node_id, norm): S / max(count, 0.1) / N over S samples with their distinct members(sample, node_id)."""
    counted = samples.select("sample", "node_id").distinct().groupBy("node_id").agg(F.count("*").alias("n"))
    total = float(nodes.count())
    seen = F.greatest(F.coalesce("n", F.lit(0)).cast("double"), F.lit(0.1))
    return nodes.select("node_id").join(counted, "node_id", "left").select("node_id", (F.lit(float(n_samples)) / seen / F.lit(total)).alias("norm"))
