"""Sampler specifications: what is refused, and that runs repeat; ordered scans and alias tables against plain versions."""

import dataclasses
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.ordered import OrderedGroups
from sparkloom.graph import PropertyGraph
from sparkloom.operators import adjacency as adj
from sparkloom.operators import features, walks
from sparkloom.plans import samplers as s


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(300)} | {(i, 7) for i in range(60)}
    edges = [(a, b) for a, b in edges if a != b and b != 13]
    return PropertyGraph(spark.range(60).withColumnRenamed("id", "node_id"), spark.createDataFrame(edges, "src long, dst long"))


def changed(spec, **parts):
    return dataclasses.replace(spec, **parts)


@pytest.mark.parametrize(
    "spec",
    [
        changed(s.graphsage([3, 2]), steps=0),
        changed(s.graphsage([3, 2]), steps=10**6),
        s.graphsage([3, -1]),
        changed(s.graphsage([3, 2]), steps=3),
        s.graphsage([3, 2], seed=None),
        changed(s.graphsage([3, 2]), select=s.Select((3, 2), by=("node_id",), key=("to",), seed=1)),
        changed(s.ladies([3], "m"), score=s.Score("sum(rand())", by=("to",))),
        changed(s.ladies([3], "m"), score=s.Score("first(m)", by=("to",))),
        changed(s.random_walk(3), select=s.Select(2, by=("walker",), key=("walker", "to"), seed=1)),
        changed(s.random_walk(3), update=(s.Append("trace", {"walker": "walker"}, "walks"),)),
        changed(s.random_walk(3), result="nothing"),
        changed(s.random_walk(3), generate=s.Neighbours("walks", "nowhere")),
        changed(s.graphsage([3, 2]), update=(s.Advance("frontier", {"node_id": "to"}, unless="missing"),)),
        changed(s.uniform_nodes(3), select=s.Select(3, key=("node_id",), order="any", seed=1)),
    ],
)
def test_unbounded_unseeded_or_odd_specifications_are_refused(spec, graph):
    with pytest.raises(ValueError):
        s.run(spec, graph)


@pytest.mark.parametrize("spec", [s.uniform_nodes(3), s.uniform_edges(3), s.weighted_nodes(3, "q"), s.weighted_edges(3, "w"), s.graphsage([3, 2]), s.ladies([3], "m"), s.random_walk(4, weight="p"), s.pinsage(3, 2), s.cluster_nodes(2)])
def test_specifications_are_data(spec):
    s.check(spec)
    assert s.from_json(s.to_json(spec)) == spec


def test_tables_that_a_specification_lacks_are_refused(graph):
    with pytest.raises(ValueError):
        s.run(s.graphsage([2]), graph, other=graph.nodes)


def test_nothing_to_start_from(graph):
    assert s.run(s.graphsage([3, 2]), graph).collect() == []


def test_runs_repeat_and_dead_ends_stay(spark, graph):
    start = {"walks": graph.nodes.select(F.col("node_id").alias("walker"), F.col("node_id").alias("at"), F.lit(None).cast("long").alias("prev"))}
    start["trace"] = graph.nodes.select(F.col("node_id").alias("walker"), F.lit(0).alias("step"), "node_id")
    a, b = (sorted(map(tuple, s.run(s.random_walk(3), graph, **start).collect())) for _ in range(2))
    assert a == b and [r for r in a if r[0] == 13] == [(13, i, 13) for i in range(4)]


def relations(plan: str) -> int:
    return plan.count("LogicalRDD") + plan.count("Scan ") + plan.count("Relation ")


def test_plans_grow_in_line_with_steps(spark, graph):
    seeds = graph.nodes.where("node_id < 5")
    sizes = [relations(walks.walk(graph, seeds, n)._jdf.queryExecution().optimizedPlan().toString()) for n in (8, 16, 24)]
    assert sizes[2] - sizes[1] <= sizes[1] - sizes[0] + 2
    assert relations(features.propagate_labels(graph, 3, 8)._jdf.queryExecution().optimizedPlan().toString()) <= 2


# ---- scans over ordered groups


def test_scans_over_groups_that_span_parts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(400), rng.randrange(9) if rng.random() < 0.4 else None, i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, t int, v int, i int").repartition(4)
    got = OrderedGroups(frame, ["g"], ["t", "i"], parts=7)
    assert got.rows.groupBy("g").agg(F.count_distinct("__part").alias("n")).where("g = 'hot'").first()["n"] > 3
    groups = defaultdict(list)
    for g, t, v, i in rows:
        groups[g].append((t, i, v))
    position, total, onward = {}, {}, {}
    for members in groups.values():
        members.sort(key=lambda m: m[:2])
        so_far = None
        for n, (_, i, v) in enumerate(members):
            so_far = so_far if v is None else (so_far or 0) + v
            position[i], total[i] = n, so_far
            onward[i] = next((w for _, _, w in members[n:] if w is not None), None)
    assert {r.i: r.position for r in got.positions().collect()} == position
    assert {r.i: r.x for r in got.running(x=F.col("v")).collect()} == total
    assert {r.i: r.x for r in got.following(x=F.col("v")).collect()} == onward


def test_small_inputs_give_the_same_by_windows(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 500).alias("t"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"), "id")
    small, large = (OrderedGroups(rows, ["g"], ["t", "id"], parts=p) for p in (None, 5))
    assert small.shared is None and large.shared is not None
    for scan in (lambda x: x.positions(), lambda x: x.running(s=F.col("v")), lambda x: x.following(s=F.col("v"))):
        assert Counter(map(tuple, scan(small).collect())) == Counter(map(tuple, scan(large).collect()))


def test_scans_of_nothing_and_of_one_group(spark):
    nothing = OrderedGroups(spark.createDataFrame([], "g int, t int"), ["g"], ["t"])
    assert nothing.positions().collect() == [] == nothing.following(x=F.col("t")).collect()
    one = OrderedGroups(spark.range(50), [], ["id"], parts=3)
    assert sorted((r.id, r.position) for r in one.positions().collect()) == [(i, i) for i in range(50)]


# ---- alias tables


def test_alias_masses_are_the_weights(spark):
    rng = random.Random(6)
    edges = [(n, t, rng.choice([1, 1, 2, 50, 1000, 0, -3])) for n in range(12) for t in range(rng.randrange(1, 40))] + [(99, t, 5) for t in range(30)] + [(98, 3, 7)]
    table = adj.AliasTable.of(spark.createDataFrame(edges, "node long, to long, weight long"))
    some = [e for e in edges if e[2] > 0]
    size = Counter(n for n, _, _ in some)
    assert {(r.node, r.to): r.mass for r in table.masses().collect()} == {(n, t): size[n] * w for n, t, w in some}
    rows = table.slots.collect()
    assert all(0 <= r.threshold <= r.capacity and (r.alias is not None or r.threshold == r.capacity) for r in rows) and len(rows) == len(some)


def test_weighted_walk_follows_the_weights(spark):
    edges = spark.createDataFrame([(0, 1, 1), (0, 2, 3), (0, 3, 6)], "node long, to long, weight long")
    table = adj.AliasTable.of(edges)
    # many walkers on one node: each is its own draw
    drawn = walks_from(spark, table, 4000)
    assert all(abs(drawn[t] / 4000 - p) < 0.03 for t, p in ((1, 0.1), (2, 0.3), (3, 0.6)))


def walks_from(spark, table, n):
    start = spark.range(1000, 1000 + n).select(F.col("id").alias("node_id"))
    moved = adj.AliasTable(table.slots.unionByName(start.select(F.col("node_id").alias("node"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("to"), F.lit(None).cast("long").alias("alias"), F.lit(1).cast("long").alias("threshold"), F.lit(1).cast("long").alias("capacity"), F.lit(1).cast("long").alias("degree"))), table.degrees.unionByName(start.select(F.col("node_id").alias("node"), F.lit(1).cast("long").alias("degree"))))
    return Counter(r.node_id for r in adj.weighted_walk(moved, start, 2).where("step = 2").collect())


def test_replaced_draws_are_bounded(graph):
    with pytest.raises(ValueError):
        adj.replaced(adj.Adjacency.of(graph), graph.nodes, [0])
    found = adj.replaced(adj.Adjacency.of(graph), graph.nodes.where("node_id IN (7, 13)"), [5, 2]).collect()
    assert Counter((r.hop, r.dst) for r in found if r.hop == 1) == {(1, 7): 5}


def test_counted_paths_are_all_paths_where_the_limit_allows(spark):
    edges = [(1, 0), (2, 0), (0, 1), (2, 1), (3, 2), (1, 3), (4, 9)]
    graph = PropertyGraph(spark.range(10).withColumnRenamed("id", "node_id"), spark.createDataFrame(edges, "src long, dst long"))
    seeds = spark.createDataFrame([(0,), (5,), (9,)], "node_id long")
    into = defaultdict(list)
    for a, b in edges:
        into[b].append(a)

    def paths(at, used, left):
        for a in into[at]:
            if (a, at) not in used:
                yield (*used, (a, at))
                if left > 1:
                    yield from paths(a, (*used, (a, at)), left - 1)

    def found(limit):
        rows = defaultdict(dict)
        for r in adj.counted_paths(graph, seeds, 4, limit).collect():
            rows[r.root, r.draw][r.step] = (r.src, r.dst)
        return [(root, tuple(steps[i] for i in range(len(steps)))) for (root, _), steps in rows.items()]

    want = {(r, p) for r in (0, 5, 9) for p in paths(r, (), 4)}
    whole = found(1000)
    assert len(whole) == len(set(whole)) and set(whole) == want
    few = found(3)
    assert set(few) <= want and Counter(r for r, _ in few) == {0: 3, 9: 1}
