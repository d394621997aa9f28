"""Bounded neighbourhood sampling: every hop is a join, a top-k by tape for each centre, and an anti-join with what was visited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut
from sparkloom.functions.tape import tape, uniform
from sparkloom.graph import PropertyGraph

SEED = 42


def top_k(rows: DataFrame, by: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each group; k < 0 keeps all. Planned with a group limit below the shuffle, so hubs are cut early."""
    if k < 0:
        return rows
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def expand(view: DataFrame, frontier: DataFrame, k: int, hop: int, seed: int = SEED) -> DataFrame:
    """(src, dst) sampled without replacement for each centre in frontier(node_id); all where there are no more than k."""
    found = view.join(frontier.select(F.col("node_id").alias("dst")), "dst")
    return top_k(found, ["dst"], k, tape(seed, hop, "dst", "src")).select("src", "dst")


def fanout(graph: PropertyGraph, seeds: DataFrame, fanouts: list[int], *, direction: str = "incoming", expand_revisited: bool = False, neighbor_label: str | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(nodes(node_id, hop), edges(hop, src, dst)). Edges to visited nodes are recorded but don't enter the frontier, unless expand_revisited."""
    view = graph.view(direction)
    if neighbor_label is not None:
        view = view.join(graph.nodes.where(F.col("label") == neighbor_label).select(F.col("node_id").alias("src")), "src", "left_semi")
    start = seeds.select("node_id").distinct().join(graph.nodes.select("node_id"), "node_id", "left_semi")
    frontier, visited, edges = start, start.withColumn("hop", F.lit(0)), None
    for hop, k in enumerate(fanouts or [-1], 1):
        # the next hops, the nodes and the edges all read it: it is drawn once
        drawn = cut(expand(view, frontier, k, hop, seed))
        edges = drawn.withColumn("hop", F.lit(hop)) if edges is None else edges.unionByName(drawn.withColumn("hop", F.lit(hop)))
        reached = drawn.select(F.col("src").alias("node_id")).distinct()
        fresh = cut(reached.join(visited.select("node_id"), "node_id", "left_anti"))
        visited = visited.unionByName(fresh.withColumn("hop", F.lit(hop)))
        frontier = reached if expand_revisited else fresh
    return visited, edges.select("hop", "src", "dst")


def last_frontier(nodes: DataFrame) -> DataFrame:
    """Nodes of the last hop that reached any, above 0."""
    last = nodes.where("hop > 0").agg(F.max("hop").alias("last"))
    return nodes.join(F.broadcast(last), F.col("hop") == F.col("last"), "left_semi").select("node_id")


def induced_sample(graph: PropertyGraph, seeds: DataFrame, fanouts: list[int], seed: int = SEED) -> DataFrame:
    """All edges among the nodes that incoming expansion visits, each in both orientations, without self-loops."""
    nodes, _ = fanout(graph, seeds, fanouts, seed=seed)
    inner = graph.induced(nodes).edges.where("src <> dst")
    pairs = inner.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst")


def disjoint(graph: PropertyGraph, seeds: DataFrame, fanouts: list[int], seed: int = SEED) -> DataFrame:
    """(root, hop, src, dst): every seed has its own visited set; visited neighbours are dropped before the draw."""
    view = cut(graph.view("undirected"))
    frontier = seeds.select(F.col("node_id").alias("root"), "node_id").distinct()
    visited, edges = frontier, None
    for hop, k in enumerate(fanouts, 1):
        found = view.join(frontier.select("root", F.col("node_id").alias("dst")), "dst")
        found = found.join(visited.select("root", F.col("node_id").alias("src")), ["root", "src"], "left_anti")
        drawn = cut(top_k(found, ["root", "dst"], k, tape(seed, hop, "root", "dst", "src")).select(F.lit(hop).alias("hop"), "root", "src", "dst"))
        edges = drawn if edges is None else edges.unionByName(drawn)
        frontier = drawn.select("root", F.col("src").alias("node_id")).distinct()
        visited = visited.unionByName(frontier)
    return edges.distinct()


def with_replacement(graph: PropertyGraph, seeds: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """(dst, draw, src): k independent draws for each seed that has a neighbour."""
    own = Window.partitionBy("dst")
    ranked = graph.view().join(seeds.select(F.col("node_id").alias("dst")).distinct(), "dst").select("dst", "src", (F.row_number().over(own.orderBy("src")) - 1).alias("i"))
    sizes = ranked.groupBy("dst").agg(F.count("*").alias("n"))
    draws = sizes.select("dst", "n", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw"))
    draws = draws.withColumn("i", F.floor(uniform(tape(seed, "r", "dst", "draw")) * F.col("n")).cast("int"))
    return draws.join(ranked, ["dst", "i"]).select("dst", F.col("draw").cast("long").alias("draw"), "src")


def paths(graph: PropertyGraph, seeds: DataFrame, hops: int, limit: int, seed: int = SEED) -> DataFrame:
    """(root, step, src, dst): edges of up to `limit` paths a seed with no repeated edge, drawn by tape; edges repeat between paths."""
    step = graph.view().select(F.col("dst").alias("at"), F.col("src").alias("to"))
    now = seeds.select(F.col("node_id").alias("root"), F.col("node_id").alias("at"), F.array().cast("array<string>").alias("used")).distinct()
    every = None
    for _ in range(hops):
        edge = F.concat_ws(">", "at", "to")
        now = now.join(step, "at").where(~F.array_contains("used", edge)).select("root", F.col("to").alias("at"), F.concat("used", F.array(edge)).alias("used"))
        every = now if every is None else every.unionByName(now)
    chosen = top_k(every.withColumn("path", F.concat_ws("|", "used")), ["root"], limit, tape(seed, "p", "root", "path"), "path")
    pair = F.split("edge", ">")
    return chosen.select("root", F.posexplode("used").alias("step", "edge")).select("root", F.col("step").cast("long").alias("step"), pair[1].cast("long").alias("src"), pair[0].cast("long").alias("dst"))


def relabel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Local ids by (hop, node_id) from 0, and the edges in them."""
    first = nodes.groupBy("node_id").agg(F.min("hop").alias("hop"))
    local = dense_index(first, "hop", "node_id").select("node_id", "local_id")
    out = edges.join(local.select(F.col("node_id").alias("src"), F.col("local_id").alias("local_src")), "src")
    out = out.join(local.select(F.col("node_id").alias("dst"), F.col("local_id").alias("local_dst")), "dst")
    return local, out


def dense_index(rows: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """`rows` with local_id = 0, 1, ... in this order, without a window over the table.

    Rows are dealt by ranges of the order; each part numbers its own rows, and
    part totals (one row for each part) give the offsets. The dealt rows are
    checkpointed: bounds of ranges are drawn from a sample, so totals and numbers
    must not each deal the rows anew.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part").orderBy(*order)
    totals = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = totals.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))
    numbered = dealt.withColumn("__rn", F.row_number().over(within)).join(F.broadcast(before), "__part")
    return numbered.withColumn("local_id", (F.col("__rn") - 1 + F.col("__base")).cast("long")).drop("__part", "__rn", "__base")


def remap_with_seeds(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id, local_id) of the sorted union of sampled nodes and seeds; seeds without edges stay."""
    return dense_index(nodes.select("node_id").unionByName(seeds.select("node_id")).distinct(), "node_id")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges that only one of two samples holds, as bags."""
    a, b = a.select("src", "dst"), b.select("src", "dst")
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def order_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(place, first, second): places where two numbered lists of nodes (node_id, local_id) differ; a list that ends earlier gives nulls."""
    left, right = (x.select(F.col("local_id").alias("place"), F.col("node_id").alias(n)) for x, n in ((a, "first"), (b, "second")))
    return left.join(right, "place", "full_outer").where(~F.col("first").eqNullSafe(F.col("second")))


def split_seeds(nodes: DataFrame, split: str, *, limit: int | None = None, offset: int | None = None, shuffle: bool = False, seed: int = SEED) -> DataFrame:
    """Seeds of a split by id. The limit applies before the offset, so limit - offset rows come back; a shuffle can't have an offset."""
    if split not in ("train", "val", "test", "unknown"):
        raise ValueError(f"no such split: {split}")
    if shuffle and offset:
        raise ValueError("a shuffled split has no offset")
    rows = nodes.where(F.col("split") == split).select("node_id")
    rows = rows.orderBy(tape(seed, "s", "node_id") if shuffle else "node_id")
    rows = rows.limit(limit) if limit is not None else rows
    return rows.offset(offset) if offset else rows


def page(nodes: DataFrame, split: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit of a split by id."""
    return nodes.where(F.col("split") == split).select("node_id").orderBy("node_id").offset(offset).limit(limit)


def shard(seeds: DataFrame, rank: int, world: int, seed: int = SEED) -> DataFrame:
    """Every world-th seed of the shuffled order, from `rank`."""
    return dense_index(seeds.select("node_id").withColumn("t", tape(seed, "d", "node_id")), "t", "node_id").where(F.col("local_id") % world == rank).select("node_id")


def batches(seeds: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """(node_id, batch_id): consecutive chunks by id."""
    rows = dense_index(seeds.select("node_id"), "node_id").select("node_id", F.floor(F.col("local_id") / size).cast("long").alias("batch_id"))
    if not drop_last:
        return rows
    full = rows.groupBy("batch_id").agg(F.count("*").alias("n")).where(F.col("n") == size).select("batch_id")
    return rows.join(full, "batch_id", "left_semi")


def ordered_lookup(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pos, node_id) of requested ids that exist, in the order and number they were asked for."""
    return requests.join(nodes.select("node_id"), "node_id", "left_semi").select("pos", "node_id")


def is_train(split: str) -> Column:
    """True where a split says `train` or, as a number, 0; false for null and anything else."""
    return F.coalesce((F.col(split).cast("string") == "train") | (F.expr(f"try_cast(`{split}` AS int)") == 0), F.lit(False))
