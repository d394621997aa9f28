"""Samplers as specifications: what a step generates, scores, selects and updates, over a state of named tables.

A specification is plain data (strings of SQL expressions, numbers, names), so that it
can be stored and read back. `check` refuses what has no bounded, repeatable plan; `run`
compiles it to joins, group limits and aggregations, one cut a step, in a number of jobs
that depends on the number of steps only.

In a step, the candidates have the columns of the state table they come from, the
candidate's own (`to` for neighbours, `node_id` for nodes, `src` and `dst` for edges),
stored properties, `step` (from 1) and, once scored, `score`.
"""

from __future__ import annotations

import dataclasses
import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut
from sparkloom.functions.tape import weighted_key
from sparkloom.graph import PropertyGraph
from sparkloom.operators.sampling import SEED, top_k

#: A specification has at most so many steps, and draws at most so many candidates for a group.
MAX_STEPS, MAX_DRAWS = 100, 1_000_000
#: Functions whose values differ between runs.
_RANDOM = re.compile(r"\b(rand|randn|random|randstr|uniform|shuffle|uuid|monotonically_increasing_id|spark_partition_id|input_file_\w+|now|current_\w+|localtimestamp|unix_timestamp|first|last|any_value|first_value|last_value|collect_list|collect_set|array_agg)\s*\(", re.IGNORECASE)


@dataclass(frozen=True)
class Neighbours:
    """Candidates `to` next to column `at` of a state table. `at_properties` are stored ones of the node in `at`, `edge_properties` of the edge."""

    of: str
    at: str
    direction: str = "incoming"
    where: str | None = None
    at_properties: tuple[str, ...] = ()
    edge_properties: tuple[str, ...] = ()
    own = ("to",)


@dataclass(frozen=True)
class AllNodes:
    """Every node, with stored properties."""

    where: str | None = None
    properties: tuple[str, ...] = ()
    own = ("node_id",)


@dataclass(frozen=True)
class AllEdges:
    """Every edge, with stored properties."""

    where: str | None = None
    properties: tuple[str, ...] = ()
    own = ("src", "dst")


@dataclass(frozen=True)
class Score:
    """A value for each candidate; with `by`, an aggregate over the candidates that agree in these columns, which are then one candidate."""

    value: str = "1"
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Select:
    """The first k candidates of each group: by the tape, by the tape in proportion to the score, or by descending score.

    k is a number or one for each step. The tape is read at (seed, salt, key); seed is
    a number or a column, salt a text in which {step} stands for the step.
    """

    k: int | tuple[int, ...]
    by: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    order: str = "tape"
    seed: int | str | None = None
    salt: str = "{step}"

    def draws(self, step: int) -> int:
        return self.k if isinstance(self.k, int) else self.k[step - 1]


@dataclass(frozen=True)
class Replace:
    """The table becomes these columns of the selection (or of another table)."""

    table: str
    columns: dict[str, str]
    source: str = "selected"


@dataclass(frozen=True)
class Append:
    """Bag union with these columns of the selection (or of another table, as it is by now)."""

    table: str
    columns: dict[str, str]
    source: str = "selected"


@dataclass(frozen=True)
class Advance:
    """The table becomes the distinct rows of these columns of the selection, without those whose columns are in the table `unless`."""

    table: str
    columns: dict[str, str]
    unless: str | None = None


@dataclass(frozen=True)
class Mutate:
    """Each row for which one was selected takes these values; others stay. The selection holds one row at most for each `key`."""

    table: str
    key: tuple[str, ...]
    columns: dict[str, str]


@dataclass(frozen=True)
class Increment:
    """Groups `by` of the table and of the rows of another table where `where` holds; `count` is summed, 1 for a new row."""

    table: str
    by: dict[str, str]
    count: str
    source: str
    where: str = "true"


@dataclass(frozen=True)
class Sampler:
    """tables: schema of each state table, as DDL. result: the table that is returned, of which `best` selects rows at the end."""

    name: str
    steps: int
    tables: dict[str, str]
    generate: Neighbours | AllNodes | AllEdges
    select: Select
    update: tuple[Replace | Append | Advance | Mutate | Increment, ...]
    result: str
    score: Score = Score()
    best: Select | None = None


_KINDS = {c.__name__: c for c in (Neighbours, AllNodes, AllEdges, Score, Select, Replace, Append, Advance, Mutate, Increment, Sampler)}


def to_json(spec: Sampler) -> str:
    def plain(x: Any) -> Any:
        if dataclasses.is_dataclass(x):
            return {"is": type(x).__name__} | {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
        if isinstance(x, tuple):
            return [plain(y) for y in x]
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x

    return json.dumps(plain(spec))


def from_json(text: str) -> Sampler:
    def made(x: Any) -> Any:
        if isinstance(x, list):
            return tuple(made(y) for y in x)
        if isinstance(x, dict):
            inner = {k: made(v) for k, v in x.items() if k != "is"}
            return _KINDS[x["is"]](**inner) if "is" in x else inner
        return x

    return made(json.loads(text))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(",")]


def check(spec: Sampler) -> None:
    """ValueError for a specification that is unbounded, not repeatable, or at odds with its own tables."""

    def require(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"{spec.name}: {what}")

    require(isinstance(spec.steps, int) and 1 <= spec.steps <= MAX_STEPS, f"the number of steps must be 1 to {MAX_STEPS}")
    require(spec.result in spec.tables, "the result is no state table")
    texts = [spec.generate.where, spec.score.value, *(v for u in spec.update for v in (u.by if isinstance(u, Increment) else u.columns).values()), *(u.where for u in spec.update if isinstance(u, Increment))]
    for text in texts:
        require(not text or not _RANDOM.search(text), f"`{text}` isn't repeatable")
    if isinstance(spec.generate, Neighbours):
        require(spec.generate.of in spec.tables and spec.generate.at in _names(spec.tables[spec.generate.of]), "candidates come from an unknown column")
        require(spec.generate.direction in ("incoming", "outgoing", "undirected"), "no such direction")
        require(not spec.generate.edge_properties or spec.generate.direction != "undirected", "edge properties have a direction")
    for select in (spec.select, *([spec.best] if spec.best else [])):
        ks = [select.k] if isinstance(select.k, int) else list(select.k)
        require(bool(ks) and all(isinstance(k, int) and 1 <= k <= MAX_DRAWS for k in ks), "the number of draws must be bounded and positive")
        require(isinstance(select.k, int) or len(ks) == spec.steps and select is spec.select, "a number of draws is needed for each step")
        require(select.order in ("tape", "weighted", "score"), "no such order")
        require(select.order == "score" or select.seed is not None, "a random selection needs a seed")
    own = spec.score.by or spec.generate.own
    # a seed that is a column tells groups apart as well
    require(set(own) | set(spec.select.by) <= {*spec.select.key, spec.select.seed}, "the key of a selection must tell all candidates apart")
    for u in spec.update:
        require(u.table in spec.tables, f"no table {u.table}")
        columns = _names(spec.tables[u.table])
        source = getattr(u, "source", "selected")
        require(source == "selected" and not isinstance(u, Increment) or source in spec.tables, f"no table {source}")
        if isinstance(u, Mutate):
            require(set(u.columns) | set(u.key) <= set(columns), f"{u.table} has other columns")
            require(spec.select.draws(1) == 1 and (isinstance(spec.select.k, int) or set(spec.select.k) == {1}) and set(spec.select.by) <= set(u.key), "a row can take one selected candidate only")
        elif isinstance(u, Increment):
            require([*u.by, u.count] == columns, f"{u.table} has other columns")
        else:
            require(list(u.columns) == columns, f"{u.table} has other columns")
        if isinstance(u, Advance) and u.unless:
            require(u.unless in spec.tables and set(columns) <= set(_names(spec.tables[u.unless])), "nothing to compare with")


def _tape(select: Select, step: int) -> Column:
    seed = F.lit(str(select.seed)) if isinstance(select.seed, int) else F.col(select.seed).cast("string")
    return F.md5(F.concat_ws(":", seed, F.lit(select.salt.format(step=step)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in select.key]).cast("binary"))


def _selected(rows: DataFrame, select: Select, step: int) -> DataFrame:
    if select.order == "score":
        order = [F.col("score").desc()]
    elif select.order == "tape":
        order = [_tape(select, step)]
    else:
        rows = rows.withColumn("__key", weighted_key(_tape(select, step), F.col("score").cast("double"))).where(F.col("__key").isNotNull())
        order = [F.col("__key")]
    order += [F.col(c) for c in select.key]
    k = select.draws(step)
    out = top_k(rows, list(select.by), k, *order) if select.by else rows.orderBy(*order).limit(k)
    return out.drop("__key")


class _Run:
    def __init__(self, spec: Sampler, graph: PropertyGraph, tables: dict[str, DataFrame]):
        self.spec, self.graph = spec, graph
        spark = graph.nodes.sparkSession
        self.state = {}
        for name, schema in spec.tables.items():
            given = tables[name] if name in tables else spark.createDataFrame([], schema)
            self.state[name] = given.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(",")])
        self.view = self._adjacent() if isinstance(spec.generate, Neighbours) else None

    def _adjacent(self) -> DataFrame:
        g = self.spec.generate
        if not g.edge_properties:
            return self.graph.view(g.direction).select(F.col("dst").alias(g.at), F.col("src").alias("to"))
        ends = ("dst", "src") if g.direction == "incoming" else ("src", "dst")
        return self.graph.edges.select(F.col(ends[0]).alias(g.at), F.col(ends[1]).alias("to"), *g.edge_properties)

    def candidates(self, step: int) -> DataFrame:
        g = self.spec.generate
        if isinstance(g, Neighbours):
            rows = self.state[g.of]
            if g.at_properties:
                rows = rows.join(self.graph.nodes.select(F.col("node_id").alias(g.at), *g.at_properties), g.at)
            rows = rows.join(self.view, g.at)
        else:
            rows = (self.graph.nodes if isinstance(g, AllNodes) else self.graph.edges).select(*g.own, *g.properties)
        rows = rows.withColumn("step", F.lit(step))
        rows = rows.where(g.where) if g.where else rows
        score = F.expr(self.spec.score.value).alias("score")
        return rows.groupBy(*self.spec.score.by, "step").agg(score) if self.spec.score.by else rows.select("*", score)

    def source(self, name: str, chosen: DataFrame, step: int) -> DataFrame:
        return chosen if name == "selected" else self.state[name].withColumn("step", F.lit(step))

    def apply(self, u, chosen: DataFrame, step: int) -> DataFrame:
        """The table after the update."""
        made = lambda rows, columns: rows.select(*[F.expr(v).alias(k) for k, v in columns.items()])
        now = self.state[u.table]
        match u:
            case Replace():
                return made(self.source(u.source, chosen, step), u.columns)
            case Append():
                return now.unionByName(made(self.source(u.source, chosen, step), u.columns))
            case Advance():
                rows = made(chosen, u.columns).distinct()
                return rows.join(self.state[u.unless].select(*u.columns), list(u.columns), "left_anti") if u.unless else rows
            case Mutate():
                new = chosen.select(*u.key, *[F.expr(v).alias(f"__{k}") for k, v in u.columns.items()], F.lit(True).alias("__hit"))
                both = now.join(new, list(u.key), "left")
                return both.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in u.columns else F.col(c) for c in now.columns])
            case Increment():
                more = self.source(u.source, chosen, step).where(u.where).select(*[F.expr(v).alias(k) for k, v in u.by.items()], F.lit(1).cast("long").alias(u.count))
                return now.unionByName(more).groupBy(*u.by).agg(F.sum(u.count).alias(u.count))
        raise ValueError(f"no such update: {u}")

    def step(self, step: int) -> None:
        chosen = cut(_selected(self.candidates(step), self.spec.select, step))
        for u in self.spec.update:
            after = self.apply(u, chosen, step).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in self.spec.tables[u.table].split(",")])
            # unions of cut tables stay unions; what joins or aggregates is computed once a step
            self.state[u.table] = cut(after) if isinstance(u, Mutate | Advance | Increment) else after


def run(spec: Sampler, graph: PropertyGraph, **tables: DataFrame) -> DataFrame:
    """The result of a checked specification, from these first rows of its state tables; tables not given begin empty."""
    check(spec)
    unknown = set(tables) - set(spec.tables)
    if unknown:
        raise ValueError(f"{spec.name} has no table {sorted(unknown)}")
    now = _Run(spec, graph, tables)
    for step in range(1, spec.steps + 1):
        now.step(step)
    out = now.state[spec.result]
    return _selected(out.withColumn("score", F.expr(spec.score.value if spec.best.order != "score" else _names(spec.tables[spec.result])[-1])), spec.best, spec.steps).drop("score") if spec.best else out


# ---- the named samplers


def uniform_nodes(k: int, seed: int = SEED) -> Sampler:
    return Sampler("uniform nodes", 1, {"nodes": "node_id long"}, AllNodes(), Select(k, key=("node_id",), seed=seed, salt="root"), (Replace("nodes", {"node_id": "node_id"}),), "nodes")


def uniform_edges(k: int, seed: int = SEED) -> Sampler:
    return Sampler("uniform edges", 1, {"edges": "src long,dst long"}, AllEdges(), Select(k, key=("src", "dst"), seed=seed, salt="ue"), (Replace("edges", {"src": "src", "dst": "dst"}),), "edges")


def weighted_nodes(k: int, weight: str, seed: int = SEED) -> Sampler:
    """FastGCN's layer and GraphSAINT's node sampler: nodes in proportion to a stored property."""
    return Sampler("weighted nodes", 1, {"nodes": "node_id long"}, AllNodes(properties=(weight,)), Select(k, key=("node_id",), order="weighted", seed=seed, salt="w"), (Replace("nodes", {"node_id": "node_id"}),), "nodes", Score(weight))


def weighted_edges(k: int, weight: str, seed: int = SEED) -> Sampler:
    """GraphSAINT's edge sampler."""
    return Sampler("weighted edges", 1, {"edges": "src long,dst long"}, AllEdges(properties=(weight,)), Select(k, key=("src", "dst"), order="weighted", seed=seed, salt="e"), (Replace("edges", {"src": "src", "dst": "dst"}),), "edges", Score(weight))


def graphsage(fanouts: list[int], seed: int = SEED, direction: str = "incoming") -> Sampler:
    """First rows: frontier(node_id) and visited(node_id, hop 0)."""
    return Sampler(
        "graphsage",
        len(fanouts),
        {"frontier": "node_id long", "visited": "node_id long,hop int", "sampled": "hop int,src long,dst long"},
        Neighbours("frontier", "node_id", direction),
        Select(tuple(fanouts), by=("node_id",), key=("node_id", "to"), seed=seed),
        (
            Append("sampled", {"hop": "step", "src": "to", "dst": "node_id"}),
            Advance("frontier", {"node_id": "to"}, unless="visited"),
            Append("visited", {"node_id": "node_id", "hop": "step"}, source="frontier"),
        ),
        "sampled",
    )


def ladies(sizes: list[int], mass: str, seed: int = SEED) -> Sampler:
    """`mass` is a stored property of the nodes, 1 / in-degree. First rows: frontier(node_id) and sampled(0, node_id)."""
    return Sampler(
        "ladies",
        len(sizes),
        {"frontier": "node_id long", "sampled": "layer int,node_id long"},
        Neighbours("frontier", "node_id", at_properties=(mass,)),
        Select(tuple(sizes), key=("to",), order="weighted", seed=seed, salt="l{step}"),
        (Replace("frontier", {"node_id": "to"}), Append("sampled", {"layer": "step", "node_id": "to"})),
        "sampled",
        Score(f"round(sum({mass}), 9)", by=("to",)),
    )


def random_walk(length: int, *, backtrack: bool = True, weight: str | None = None, seed: int = SEED, direction: str = "incoming") -> Sampler:
    """With `weight`, a stored property of the edges, the walk of node2vec with given transition weights. First rows: walks(walker, at, null) and trace(walker, 0, node_id)."""
    return Sampler(
        "random walk",
        length,
        {"walks": "walker long,at long,prev long", "trace": "walker long,step int,node_id long"},
        Neighbours("walks", "at", direction, where=None if backtrack else "prev IS NULL OR to <> prev", edge_properties=(weight,) if weight else ()),
        Select(1, by=("walker",), key=("walker", "to"), order="weighted" if weight else "tape", seed=seed),
        (Mutate("walks", ("walker",), {"at": "to", "prev": "at"}), Append("trace", {"walker": "walker", "step": "step", "node_id": "at"}, source="walks")),
        "trace",
        Score(weight or "1"),
    )


def pinsage(length: int, k: int) -> Sampler:
    """First rows: walks(root, seed, at), one row for each walk of a root, told apart by their seeds."""
    return Sampler(
        "pinsage",
        length,
        {"walks": "root long,seed long,at long", "visited": "root long,node_id long,visits long"},
        Neighbours("walks", "at", "undirected"),
        Select(1, by=("root", "seed"), key=("root", "to"), seed="seed"),
        (Mutate("walks", ("root", "seed"), {"at": "to"}), Increment("visited", {"root": "root", "node_id": "at"}, "visits", "walks", "at <> root")),
        "visited",
        best=Select(k, by=("root",), key=("node_id",), order="score"),
    )


def cluster_nodes(chosen: int, seed: int = SEED) -> Sampler:
    """Clusters by a stored property cluster_id; the nodes of the chosen clusters are a join away."""
    return Sampler("clusters", 1, {"clusters": "cluster_id long"}, AllNodes(properties=("cluster_id",)), Select(chosen, key=("cluster_id",), seed=seed, salt="c"), (Replace("clusters", {"cluster_id": "cluster_id"}),), "clusters", Score("count(*)", by=("cluster_id",)))
