"""Balanced partitions by rounds of moves with capacities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut
from sparkloom.functions.ordered import OrderedGroups
from sparkloom.functions.tape import tape
from sparkloom.operators.sampling import SEED, dense_index


def balanced_parts(nodes: DataFrame, pairs: DataFrame, parts: int, rounds: int = 5, slack: int = 105, seed: int = SEED) -> DataFrame:
    """(node_id, part) with no part above ceil(slack % of its equal share).

    pairs(src, dst, weight): neighbours in both directions, whole weights. The start
    deals nodes in order of ids. In a round, half of the nodes, by tape, may move to the
    part where votes * (2 capacity - load) is largest, votes being the weight of its
    neighbours there; ties go to the own part, then to the least. A part admits as many
    as it has room for before anyone leaves, first by tape, so that the capacity always
    holds. Votes are counted where the edges are; numbering of applicants is spread
    over all tasks. Weights are summed as whole numbers, so that every engine agrees.
    """
    if parts < 1 or slack < 100:
        raise ValueError("one part at least, and room for all nodes")
    now = cut(dense_index(nodes.select("node_id"), "node_id").select("node_id", F.pmod("local_id", F.lit(parts)).alias("part")))
    n = now.count()
    capacity = -(-n * slack // (100 * parts))
    pairs = cut(pairs.where("src <> dst").select("src", "dst", F.col("weight").cast("long").alias("weight")))
    best = Window.partitionBy("node_id").orderBy(F.col("score").desc(), F.col("part") != F.col("own"), "part")
    for r in range(1, rounds + 1):
        load = now.groupBy("part").agg(F.count("*").alias("load"))  # a row for each part
        # a part that lost all its nodes is open still
        load = now.sparkSession.range(parts).select(F.col("id").alias("part")).join(load, "part", "left").select("part", F.coalesce("load", F.lit(0)).alias("load"))
        votes = pairs.join(now.select(F.col("node_id").alias("src"), "part"), "src").groupBy(F.col("dst").alias("node_id"), "part").agg(F.sum("weight").alias("votes"))
        able = now.where(F.substring(tape(seed, f"b{r}", "node_id"), 1, 1) < "8").select("node_id", F.col("part").alias("own"))
        scored = votes.join(able, "node_id").join(F.broadcast(load), "part").withColumn("score", F.col("votes") * (F.lit(2 * capacity) - F.col("load")))
        chosen = scored.withColumn("rn", F.row_number().over(best)).where("rn = 1 AND part <> own").select("node_id", "part", "load", tape(seed, f"b{r}", "node_id").alias("turn"))
        placed = OrderedGroups(chosen, ["part"], ["turn"]).positions("place")
        moves = placed.where(F.col("place") < F.lit(capacity) - F.col("load")).select("node_id", F.col("part").alias("to"))
        now = cut(now.join(moves, "node_id", "left").select("node_id", F.coalesce("to", "part").alias("part")))
    return now


def weighted_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(cut, total, balance): weight of the edges(src, dst, weight) across parts and of all, and the largest part over the mean."""
    ends = edges.join(parts.select(F.col("node_id").alias("src"), F.col("part").alias("a")), "src").join(parts.select(F.col("node_id").alias("dst"), F.col("part").alias("b")), "dst")
    sums = ends.agg(F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), F.col("weight"))), F.lit(0)).alias("cut"), F.sum("weight").alias("total"))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n")).agg((F.max("n") / F.avg("n")).alias("balance"))
    return sums.join(F.broadcast(sizes))  # one row each
