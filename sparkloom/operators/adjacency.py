"""Adjacency with numbered neighbours, alias tables for weights, and the samplers that look a neighbour up by its number.

A draw is one equality join on (node, slot): a walker reads one row, whatever the
degree of the node it is on, and a hub's rows are spread over all tasks by slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut
from sparkloom.functions.ordered import OrderedGroups
from sparkloom.functions.tape import tape
from sparkloom.graph import PropertyGraph
from sparkloom.operators.sampling import SEED, top_k


def unit(hexes: Column, word: int = 0) -> Column:
    """Number in [0, 1) from 52 bits of the tape; words 0 and 1 are independent."""
    return F.conv(F.substring(hexes, 1 + 13 * word, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


@dataclass(frozen=True)
class Adjacency:
    """slots(node, slot, to, degree): neighbours of a node numbered 0, 1, ... by their id, and the neighbour's own degree; degrees(node, degree) of the nodes that have a neighbour."""

    slots: DataFrame
    degrees: DataFrame

    @classmethod
    def of(cls, graph: PropertyGraph, direction: str = "incoming") -> Adjacency:
        """From the edges of a graph, which are a set. Computed once."""
        view = graph.view(direction).select(F.col("dst").alias("node"), F.col("src").alias("to"))
        rows = cut(OrderedGroups(view, ["node"], ["to"]).positions("slot"))
        degrees = rows.groupBy("node").agg((F.max("slot") + 1).alias("degree"))
        onward = degrees.select(F.col("node").alias("to"), "degree")
        return cls(cut(rows.join(onward, "to", "left").select("node", "slot", "to", F.coalesce("degree", F.lit(0)).alias("degree"))), degrees)

    def located(self, rows: DataFrame, at: str) -> DataFrame:
        """`rows` with the `degree` of the node in column `at`, 0 without neighbours."""
        return rows.join(self.degrees.withColumnRenamed("node", at), at, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def pick(draw: Column, size: Column) -> Column:
    """A slot below `size`."""
    return F.least(F.floor(draw * size), size - 1).cast("long")


def walk(adjacency: Adjacency, start: DataFrame, length: int, seed: int = SEED) -> DataFrame:
    """(walker, step, node_id): uniform walks over numbered neighbours; a walker without a next node stays."""
    now = cut(adjacency.located(start.select(F.col("node_id").alias("walker"), F.col("node_id").alias("at")), "at"))
    steps = now.select("walker", F.lit(0).alias("step"), F.col("at").alias("node_id"))
    slots = adjacency.slots.select(F.col("node").alias("at"), "slot", "to", F.col("degree").alias("onward"))
    for s in range(1, length + 1):
        drawn = now.withColumn("slot", pick(unit(tape(seed, s, "walker")), F.col("degree")))
        moved = drawn.join(slots, ["at", "slot"], "left")
        now = cut(moved.select("walker", F.coalesce("to", "at").alias("at"), F.coalesce("onward", "degree").alias("degree")))
        steps = steps.unionByName(now.select("walker", F.lit(s).alias("step"), F.col("at").alias("node_id")))
    return steps


def replaced(adjacency: Adjacency, seeds: DataFrame, fanouts: list[int], seed: int = SEED) -> DataFrame:
    """(hop, dst, draw, src): `fanouts[h]` independent draws with replacement for each node of a hop's frontier; nodes met before don't enter it again."""
    if any(k < 1 for k in fanouts):
        raise ValueError("draws with replacement need a positive number")
    frontier = seeds.select(F.col("node_id").alias("dst")).distinct()
    visited, out = frontier, None
    slots = adjacency.slots.select(F.col("node").alias("dst"), "slot", F.col("to").alias("src"))
    for hop, k in enumerate(fanouts, 1):
        some = adjacency.located(frontier, "dst").where("degree > 0")
        draws = some.select("dst", "degree", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw"))
        draws = draws.withColumn("slot", pick(unit(tape(seed, f"r{hop}", "dst", "draw")), F.col("degree")))
        drawn = cut(draws.join(slots, ["dst", "slot"]).select(F.lit(hop).alias("hop"), "dst", F.col("draw").cast("long").alias("draw"), "src"))
        out = drawn if out is None else out.unionByName(drawn)
        frontier = cut(drawn.select(F.col("src").alias("dst")).distinct().join(visited, "dst", "left_anti"))
        visited = visited.unionByName(frontier)
    return out


@dataclass(frozen=True)
class AliasTable:
    """slots(node, slot, to, alias, threshold, capacity, degree): a slot gives `to` for draws below `threshold` of `capacity` and `alias` for others; degrees(node, degree) as in Adjacency, over neighbours of positive weight."""

    slots: DataFrame
    degrees: DataFrame

    @classmethod
    def of(cls, edges: DataFrame) -> AliasTable:
        """From edges(node, to, weight) with whole, positive weights; others are left out. Exact, and no node is held in one task.

        With n neighbours of total weight W, slot i holds n w_i, and W is a slot's
        capacity. In slot order, what light slots lack and what heavy ones have too
        much are laid on two lines of equal length. A light slot is filled by the
        heavy one where its own stretch begins; a heavy slot is filled, from where
        its stretch ends, by the next heavy one, and lacks what the light slot that
        crosses its end took beyond it. Both are looked up by one scan of all ends
        in order. n W must be below 2^63.
        """
        some = edges.where("weight > 0").select("node", "to", F.col("weight").cast("long").alias("weight"))
        numbered = cut(OrderedGroups(some, ["node"], ["to"]).positions("slot"))
        sums = cut(numbered.groupBy("node").agg(F.count("*").alias("n"), F.sum("weight").alias("capacity")))
        held = numbered.join(sums, "node").withColumn("over", F.col("n") * F.col("weight") - F.col("capacity"))
        lines = OrderedGroups(held.withColumn("heavy", F.col("over") > 0), ["node", "heavy"], ["slot"]).running(end=F.abs("over")).withColumn("size", F.abs("over"))
        lines = cut(lines)
        # kinds in order at equal places: beginnings of light stretches, ends of light ones, ends of heavy ones
        light = lines.where("over < 0").select("node", "slot", F.explode(F.array(F.struct((F.col("end") - F.col("size")).alias("place"), F.lit(0).alias("kind")), F.struct(F.col("end").alias("place"), F.lit(1).alias("kind")))).alias("e"), F.lit(None).cast("long").alias("to"))
        heavy = lines.where("over > 0").select("node", "slot", F.struct(F.col("end").alias("place"), F.lit(2).alias("kind")).alias("e"), "to")
        events = light.unionByName(heavy).select("node", F.col("e.place").alias("place"), F.col("e.kind").alias("kind"), "slot", "to")
        met = OrderedGroups(events, ["node"], ["place", "kind", "slot"]).following(by=F.when(F.col("kind") == 2, F.col("to")), crossed=F.when(F.col("kind") == 1, F.col("place")))
        # the next heavy one of a heavy slot is the first to follow it in slot order
        asks = heavy.select("node", (F.col("slot") + 1).alias("slot"), F.lit(None).cast("long").alias("to"), F.lit(0).alias("turn"))
        onward = OrderedGroups(heavy.select("node", "slot", "to", F.lit(1).alias("turn")).unionByName(asks), ["node"], ["slot", "turn"])
        after = onward.following(next=F.col("to")).where("turn = 0").select("node", (F.col("slot") - 1).alias("slot"), "next")
        filled = met.where("kind <> 1").join(after, ["node", "slot"], "left")
        filled = filled.select("node", "slot", F.when(F.col("kind") == 0, F.col("by")).when(F.col("crossed").isNotNull(), F.col("next")).alias("alias"), F.when(F.col("kind") == 2, F.col("crossed") - F.col("place")).alias("lacks"))
        slots = lines.join(filled, ["node", "slot"], "left")
        lacks = F.when(F.col("over") < 0, F.col("size")).otherwise(F.coalesce("lacks", F.lit(0)))
        degrees = sums.select("node", F.col("n").alias("degree"))
        out = slots.select("node", "slot", "to", "alias", (F.col("capacity") - lacks).alias("threshold"), "capacity", F.col("n").alias("degree"))
        return cls(cut(out), degrees)

    def masses(self) -> DataFrame:
        """(node, to, mass): the units, of degree * capacity in all, that draws give each neighbour."""
        own = self.slots.select("node", "to", F.col("threshold").alias("mass"))
        other = self.slots.where("alias IS NOT NULL").select("node", F.col("alias").alias("to"), (F.col("capacity") - F.col("threshold")).alias("mass"))
        return own.unionByName(other).groupBy("node", "to").agg(F.sum("mass").alias("mass"))


def weighted_walk(table: AliasTable, start: DataFrame, length: int, seed: int = SEED) -> DataFrame:
    """(walker, step, node_id): walks whose steps are drawn in proportion to the weights, one row read by a walker and step."""
    place = Adjacency(table.slots, table.degrees)
    slots = table.slots.select(F.col("node").alias("at"), "slot", "to", "alias", "threshold", "capacity")
    now = start.select(F.col("node_id").alias("walker"), F.col("node_id").alias("at"))
    steps = now.select("walker", F.lit(0).alias("step"), F.col("at").alias("node_id"))
    for s in range(1, length + 1):
        hexes = tape(seed, s, "walker")
        drawn = place.located(now, "at").withColumn("slot", pick(unit(hexes), F.col("degree"))).withColumn("v", unit(hexes, 1))
        moved = drawn.join(slots, ["at", "slot"], "left")
        to = F.when(pick(F.col("v"), F.col("capacity")) < F.col("threshold"), F.col("to")).otherwise(F.col("alias"))
        now = cut(moved.select("walker", F.coalesce(to, "at").alias("at")))
        steps = steps.unionByName(now.select("walker", F.lit(s).alias("step"), F.col("at").alias("node_id")))
    return steps


def counted_paths(graph: PropertyGraph, seeds: DataFrame, hops: int, limit: int, seed: int = SEED) -> DataFrame:
    """(root, draw, step, src, dst): edges of up to `limit` random paths of 1 to `hops` edges into each seed, no path twice and no edge twice in a path.

    No path is listed before it is drawn: sums from the ends backwards give the number
    of walks of each length that go on from a node, a draw is a number below their
    total, and each step finds the neighbour whose stretch of numbers it falls in, by
    one scan over the neighbours of nodes that draws are at. 2 limit + 8 numbers are
    drawn (all, where there are no more), and walks that repeat an edge are left out,
    which leaves all paths equally likely. Counts must be below 2^63.
    """
    view = cut(graph.view().select(F.col("dst").alias("at"), F.col("src").alias("to")))
    ends, stretches = None, None
    for length in range(1, hops + 1):
        onward = view.withColumn("n", F.lit(1).cast("long")) if ends is None else view.join(ends.withColumnRenamed("at", "to"), "to")
        upto = cut(OrderedGroups(onward.select("at", "to", "n"), ["at"], ["to"]).running(upto=F.col("n")).withColumn("left", F.lit(length)))
        stretches = upto if stretches is None else stretches.unionByName(upto)
        ends = upto.groupBy("at").agg(F.sum("n").alias("n"))
    roots = seeds.select(F.col("node_id").alias("root")).distinct()
    totals = stretches.groupBy(F.col("at").alias("root"), "left").agg(F.sum("n").alias("n")).join(roots, "root", "left_semi")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("root").orderBy("left").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = cut(totals.withColumn("first", before))
    drawn, wanted = lengths.groupBy("root").agg(F.sum("n").alias("total")), 2 * limit + 8
    every = F.sequence(F.lit(0).cast("long"), F.least("total", F.lit(wanted)) - 1)
    rank = F.when(F.col("total") <= wanted, F.col("i")).otherwise(pick(unit(tape(seed, "paths", "root", "i")), F.col("total")))
    drawn = drawn.withColumn("i", F.explode(every)).withColumn("rank", rank).groupBy("root", "rank").agg(F.min("i").alias("draw"))
    # where all are taken, the order of the draws is drawn
    turn = tape(seed, "turn", "root", "rank")
    now = drawn.join(lengths, "root").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    now = cut(now.select("root", "draw", turn.alias("turn"), F.col("root").alias("at"), "left", (F.col("rank") - F.col("first")).alias("rank")))
    out = None
    for step in range(hops):
        own = stretches.join(now.select("left", "at").distinct(), ["left", "at"], "left_semi")
        ask = now.select("left", "at", F.col("rank").alias("place"), F.lit(1).alias("kind"), F.struct("root", "draw", "turn").alias("who"), F.lit(None).cast("struct<to:long,first:long>").alias("hit"))
        marks = own.select("left", "at", F.col("upto").alias("place"), F.lit(0).alias("kind"), F.lit(None).cast(ask.schema["who"].dataType).alias("who"), F.struct("to", (F.col("upto") - F.col("n")).alias("first")).alias("hit"))
        met = OrderedGroups(marks.unionByName(ask), ["left", "at"], ["place", "kind"]).following(found=F.col("hit")).where("kind = 1")
        moved = cut(met.select("who.*", "at", "left", F.col("found.to").alias("to"), (F.col("place") - F.col("found.first")).alias("rank")))
        one = moved.select("root", "draw", "turn", F.lit(step).cast("long").alias("step"), F.col("to").alias("src"), F.col("at").alias("dst"))
        out = one if out is None else out.unionByName(one)
        now = moved.where("left > 1").select("root", "draw", "turn", F.col("to").alias("at"), (F.col("left") - 1).alias("left"), "rank")
    whole = out.groupBy("root", "draw", "turn").agg(F.count("*").alias("n"), F.count_distinct("src", "dst").alias("edges")).where("n = edges")
    chosen = top_k(whole, ["root"], limit, "turn", "draw").select("root", "draw")
    return out.join(chosen, ["root", "draw"], "left_semi").select("root", "draw", "step", "src", "dst")
