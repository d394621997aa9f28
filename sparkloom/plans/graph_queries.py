"""Queries over numbered adjacency and alias tables, sampler specifications and tensor expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import vectors as vec
from sparkloom.graph import PropertyGraph
from sparkloom.operators import adjacency as adj
from sparkloom.operators import aggregate as agg
from sparkloom.operators import blocks
from sparkloom.operators import features as feat
from sparkloom.operators import partition
from sparkloom.operators import sampling as smp
from sparkloom.operators import walks
from sparkloom.plans import fixtures as fx
from sparkloom.plans import samplers, stack, surface, tensor
from sparkloom.plans.catalog import SQL, _requests, _round, _tape, gcn_spec, gcn_sql, linear_sql, out_sql, query, rounded, sample_ctes, walk_ctes, weight
from sparkloom.plans.fixtures import DIM, sql
from sparkloom.plans.planner import infer


def _unit(h: str, word: int = 0) -> str:
    return f"(CAST('0x' || substr({h}, {1 + 13 * word}, 13) AS BIGINT) / {1 << 52}.0::DOUBLE)"


def _pick(u: str, n: str) -> str:
    return f"CAST(least(floor({u} * {n}), {n} - 1) AS BIGINT)"


SLOTS = "slots AS (SELECT dst AS node, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS slot, src AS dest, count(*) OVER (PARTITION BY dst) AS degree FROM {g})"


@query("adjacency_slots", sql("g1 und1", "SELECT s.node, s.slot, s.dest AS \"to\", coalesce(d.degree, 0) AS degree FROM slots s LEFT JOIN (SELECT DISTINCT node, degree FROM slots) d ON d.node = s.dest", SLOTS.format(g="und1")))
def adjacency_slots(spark, d):
    return adj.Adjacency.of(fx.graph(spark, d), "undirected").slots


@query("indexed_walk", sql("g1 seeds", "SELECT walker, step, node_id FROM w0 " + " ".join(f"UNION ALL SELECT walker, {s}, node_id FROM w{s}" for s in range(1, 9)), SLOTS.format(g="g1"), "w0 AS (SELECT node_id AS walker, 0 AS step, node_id FROM seeds)",
    *[f"w{s} AS (SELECT w.walker, coalesce(t.dest, w.node_id) AS node_id FROM w{s - 1} w LEFT JOIN (SELECT DISTINCT node, degree FROM slots) n ON n.node = w.node_id LEFT JOIN slots t ON t.node = w.node_id AND t.slot = {_pick(_unit(_tape(s, 'w.walker')), 'n.degree')})" for s in range(1, 9)]))
def indexed_walk(spark, d):
    return adj.walk(adj.Adjacency.of(fx.graph(spark, d)), fx.seeds(spark, d), 8)


def _replaced_sql(view: str) -> str:
    hop = lambda h, k: f"""h{h} AS (SELECT {h} AS hop, t.node AS dst, t.draw, s.dest AS src FROM (SELECT n.node, draw, {_pick(_unit(_tape(f'r{h}', 'n.node', 'draw')), 'n.degree')} AS slot
  FROM (SELECT DISTINCT node, degree FROM slots) n JOIN f{h - 1} f ON f.node_id = n.node, unnest(CAST(range(1, {k + 1}) AS BIGINT[])) u(draw)) t JOIN slots s ON s.node = t.node AND s.slot = t.slot)"""  # noqa: E731
    return sql(
        "g1 und1 seeds" if view == "und1" else "g1 seeds",
        "SELECT * FROM h1 UNION ALL SELECT * FROM h2",
        *(["out1 AS (SELECT dst AS src, src AS dst FROM g1)"] if view == "out1" else []),
        SLOTS.format(g=view),
        "f0 AS (SELECT node_id FROM seeds)",
        hop(1, 4),
        "f1 AS (SELECT DISTINCT src AS node_id FROM h1 WHERE src NOT IN (SELECT node_id FROM f0))",
        hop(2, 3),
    )


for _name, _direction, _view in (("in", "incoming", "g1"), ("out", "outgoing", "out1"), ("both", "undirected", "und1")):

    def _replaced(spark, d, direction=_direction):
        return adj.replaced(adj.Adjacency.of(fx.graph(spark, d), direction), fx.seeds(spark, d), [4, 3])

    query(f"replaced_2hop_{_name}", _replaced_sql(_view))(_replaced)


#: Edge weights of the weighted queries, 1 to 9.
_WEIGHT = "1 + (src * 7 + dst * 3) % 9"


def _weighted(spark, d) -> adj.AliasTable:
    return adj.AliasTable.of(fx.graph(spark, d).edges.select(F.col("dst").alias("node"), F.col("src").alias("to"), F.expr(_WEIGHT).alias("weight")))


@query("alias_masses", sql("g1", f"SELECT dst AS node, src AS \"to\", CAST(count(*) OVER (PARTITION BY dst) * ({_WEIGHT}) AS BIGINT) AS mass FROM g1"))
def alias_masses(spark, d):
    return _weighted(spark, d).masses()


ALIAS = [
    f"e AS (SELECT dst AS node, src AS dest, {_WEIGHT} AS w, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS slot, count(*) OVER (PARTITION BY dst) AS n FROM g1)",
    "c AS (SELECT *, CAST(sum(w) OVER (PARTITION BY node) AS BIGINT) AS cap FROM e)",
    "lines AS (SELECT *, n * w - cap AS over_, CAST(sum(abs(n * w - cap)) OVER (PARTITION BY node, n * w > cap ORDER BY slot) AS BIGINT) AS fin FROM c)",
    "hv AS (SELECT *, lead(dest) OVER (PARTITION BY node ORDER BY slot) AS nxt FROM lines WHERE over_ > 0)",
    "lt AS (SELECT *, fin + over_ AS beg FROM lines WHERE over_ < 0)",
    "filled AS (SELECT l.node, l.slot, h.dest AS alias, -l.over_ AS lacks FROM lt l ASOF JOIN hv h ON l.node = h.node AND l.beg <= h.fin",
    "  UNION ALL SELECT h.node, h.slot, CASE WHEN l.node IS NOT NULL THEN h.nxt END, coalesce(l.fin - h.fin, 0) FROM hv h ASOF LEFT JOIN lt l ON l.node = h.node AND h.fin < l.fin)",
    "tab AS (SELECT l.node, l.slot, l.dest, f.alias, l.cap - coalesce(f.lacks, 0) AS threshold, l.cap, l.n FROM lines l LEFT JOIN filled f ON f.node = l.node AND f.slot = l.slot)",
]
ALIAS = [*ALIAS[:5], ALIAS[5] + "\n" + ALIAS[6], ALIAS[7]]


@query("alias_table", sql("g1", "SELECT node, slot, dest AS \"to\", alias, threshold, cap AS capacity, n AS degree FROM tab", *ALIAS))
def alias_table(spark, d):
    return _weighted(spark, d).slots


@query("alias_walk", sql("g1 seeds", "SELECT walker, step, node_id FROM w0 " + " ".join(f"UNION ALL SELECT walker, {s}, node_id FROM w{s}" for s in range(1, 6)), *ALIAS, "w0 AS (SELECT node_id AS walker, 0 AS step, node_id FROM seeds)",
    *[f"w{s} AS (SELECT w.walker, coalesce(CASE WHEN {_pick(_unit(_tape(s, 'w.walker'), 1), 't.cap')} < t.threshold THEN t.dest ELSE t.alias END, w.node_id) AS node_id FROM w{s - 1} w LEFT JOIN (SELECT DISTINCT node, n FROM tab) n ON n.node = w.node_id LEFT JOIN tab t ON t.node = w.node_id AND t.slot = {_pick(_unit(_tape(s, 'w.walker')), 'n.n')})" for s in range(1, 6)]))
def alias_walk(spark, d):
    return adj.weighted_walk(_weighted(spark, d), fx.seeds(spark, d), 5)


# ---- samplers as specifications; the SQL is that of the samplers written by hand


def _seed_rows(spark, d, **columns):
    return fx.seeds(spark, d).select(*[F.expr(v).alias(k) for k, v in columns.items()])


@query("spec_uniform_node", SQL["uniform_node"])
def spec_uniform_node(spark, d):
    return samplers.run(samplers.uniform_nodes(50), fx.graph(spark, d))


@query("spec_uniform_edge", SQL["uniform_edge"])
def spec_uniform_edge(spark, d):
    return samplers.run(samplers.uniform_edges(200), fx.graph(spark, d))


def _with_degrees(spark, d, **properties) -> PropertyGraph:
    g = fx.graph(spark, d)
    stored = g.nodes.join(g.degrees(), "node_id")
    return PropertyGraph(stored.select("node_id", *[F.expr(v).alias(k) for k, v in properties.items()]), g.edges)


@query("spec_fastgcn", SQL["fastgcn"])
def spec_fastgcn(spark, d):
    return samplers.run(samplers.weighted_nodes(60, "q"), _with_degrees(spark, d, q="CAST(degree AS DOUBLE)"))


@query("spec_saint_edge", SQL["saint_edge"])
def spec_saint_edge(spark, d):
    g = fx.graph(spark, d)
    return samplers.run(samplers.weighted_edges(100, "weight"), PropertyGraph(g.nodes, walks.edge_importance(g)))


@query("spec_graphsage", SQL["sample_2hop"])
def spec_graphsage(spark, d):
    return samplers.run(samplers.graphsage([10, 5]), fx.graph(spark, d), frontier=fx.seeds(spark, d), visited=_seed_rows(spark, d, node_id="node_id", hop="0"))


@query("spec_ladies", SQL["ladies"])
def spec_ladies(spark, d):
    g = _with_degrees(spark, d, mass="CASE WHEN degree > 0 THEN 1 / CAST(degree AS DOUBLE) END")
    return samplers.run(samplers.ladies([40, 30], "mass"), g, frontier=fx.seeds(spark, d), sampled=_seed_rows(spark, d, layer="0", node_id="node_id"))


def _walk_start(spark, d):
    return {"walks": _seed_rows(spark, d, walker="node_id", at="node_id", prev="CAST(NULL AS BIGINT)"), "trace": _seed_rows(spark, d, walker="node_id", step="0", node_id="node_id")}


@query("spec_random_walk", SQL["random_walk_nb"])
def spec_random_walk(spark, d):
    return samplers.run(samplers.random_walk(4, backtrack=False, direction="undirected"), fx.graph(spark, d), **_walk_start(spark, d))


@query("spec_node2vec", sql("g1 seeds", "SELECT walker, step, node_id FROM w", *walk_ctes("g1", "seeds", 4, back=False, weight="CAST(1 + (e.src * 7 + e.dst) % 5 AS DOUBLE)")))
def spec_node2vec(spark, d):
    g = fx.graph(spark, d)
    weighted = PropertyGraph(g.nodes, g.edges.withColumn("p", (1 + (F.col("src") * 7 + F.col("dst")) % 5).cast("double")))
    # stored and read back: a specification is data
    spec = samplers.from_json(samplers.to_json(samplers.random_walk(4, backtrack=False, weight="p")))
    return samplers.run(spec, weighted, **_walk_start(spark, d))


@query("spec_pinsage", SQL["pinsage_topk"])
def spec_pinsage(spark, d):
    start = fx.seeds(spark, d).select(F.col("node_id").alias("root"), F.explode(F.sequence(F.lit(100), F.lit(103))).alias("seed"), F.col("node_id").alias("at"))
    return samplers.run(samplers.pinsage(3, 4), fx.graph(spark, d), walks=start)


@query("spec_cluster_gcn", SQL["cluster_gcn"])
def spec_cluster_gcn(spark, d):
    nodes = fx.nodes(spark, d).withColumn("cluster_id", F.pmod("node_id", F.lit(16)))
    chosen = samplers.run(samplers.cluster_nodes(4), PropertyGraph(nodes, fx.graph(spark, d).edges))
    return nodes.join(chosen, "cluster_id", "left_semi").select("node_id", "cluster_id")


# ---- tensor expressions

_GCN16 = [f"lin AS ({linear_sql('x', 16, with_bias=False)})", f"y AS (SELECT node_id, dim, greatest(v, 0.0::DOUBLE) AS v FROM ({gcn_sql('g1', 'deg1', 'lin', 'x')}))"]


def _features(v: str) -> tensor.Expression:
    return tensor.Feature("features", v)


@query("tensor_gcn", sql("g1 x deg1", out_sql("y"), *_GCN16))
def tensor_gcn(spark, d):
    out = tensor.evaluate(fx.graph(spark, d), tensor.gcn_layer(_features, weight(16, DIM)), complete=True)
    return vec.long_form(out.select(F.col("x").alias("node_id"), F.col("val").alias("h")), "h")


@query("tensor_gcn_readout", sql("g1 x deg1", f"SELECT 0 AS node_id, dim, {_round('sum(v)', 4)} AS h FROM y GROUP BY dim", *_GCN16))
def tensor_gcn_readout(spark, d):
    out = tensor.evaluate(fx.graph(spark, d), tensor.readout(lambda v: tensor.gcn_layer(_features, weight(16, DIM), v)))
    return out.select(F.lit(0).alias("node_id"), F.posexplode("val").alias("dim", "h")).select("node_id", F.col("dim").cast("long").alias("dim"), rounded(F.col("h"), 4).alias("h"))


@query("tensor_triangles", sql("g1", "SELECT CAST(count(*) AS DOUBLE) AS val FROM g1 a JOIN g1 b ON b.src = a.dst JOIN g1 c ON c.src = b.dst AND c.dst = a.src"))
def tensor_triangles(spark, d):
    return tensor.evaluate(fx.graph(spark, d), tensor.triangles())


@query("tensor_two_walks", sql("g1 nodes", f"SELECT n.node_id AS x, {_round('coalesce(w.s, 0) * (SELECT count(*) FROM nodes)')} AS val FROM nodes n LEFT JOIN (SELECT a.dst AS x, sum(c.target + 1.0::DOUBLE) AS s FROM g1 a JOIN g1 b ON b.dst = a.src JOIN nodes c ON c.node_id = b.src GROUP BY a.dst) w ON w.x = n.node_id"))
def tensor_two_walks(spark, d):
    """Sum over walks of two edges into x of the first node's label plus 1, times the number of nodes (a sum without a guard)."""
    inner = tensor.Sum("z", tensor.Edge("z", "y") * (tensor.Feature("target", "z") + 1))
    e = tensor.Sum("y", tensor.Edge("y", "x") * inner) * tensor.Sum("all", tensor.Const(1.0))
    return tensor.evaluate(fx.graph(spark, d), e, complete=True).select("x", rounded(F.col("val")).alias("val"))


# ---- the graph operators called from SQL text


def _surface(spark, d) -> None:
    surface.register(spark, fx.graph(spark, d), "g", DIM)
    fx.seeds(spark, d).createOrReplaceTempView("g_seeds")


@query("surface_fetch", sql("nodes", f"SELECT o_orderkey AS pos, o_custkey AS node_id, CAST(k - 1 AS BIGINT) AS dim, {_round('CAST(embedding[k] AS DOUBLE)')} AS h, CAST(label AS BIGINT) AS target FROM orders JOIN embeddings ON vec_id = o_custkey, unnest([1, 64]) u(k)"))
def surface_fetch(spark, d):
    _surface(spark, d)
    fx.table(spark, d, "orders").createOrReplaceTempView("g_requests")
    out = spark.sql("SELECT r.o_orderkey AS pos, f.node_id, CAST(dim AS BIGINT) AS dim, f.features[dim] AS h, f.target FROM g_requests r JOIN g_fetch() f ON f.node_id = r.o_custkey LATERAL VIEW explode(array(0, 63)) AS dim")
    return out.withColumn("h", rounded(F.col("h")))


@query("surface_sample_2hop", SQL["sample_2hop"])
def surface_sample_2hop(spark, d):
    _surface(spark, d)
    return spark.sql("""
      WITH one AS (SELECT 1 AS hop, src, dst FROM sample_neighbours(TABLE(SELECT e.dst, e.src FROM g_edges e JOIN g_seeds s ON s.node_id = e.dst), 10, 42, 1)),
      frontier AS (SELECT DISTINCT src AS node_id FROM one WHERE src NOT IN (SELECT node_id FROM g_seeds)),
      sliced AS (SELECT dst, src FROM sample_neighbours(TABLE(SELECT e.dst, e.src FROM g_edges e JOIN frontier f ON f.node_id = e.dst), 5, 42, 2, 4))
      SELECT hop, src, dst FROM one UNION ALL SELECT 2, src, dst FROM sample_neighbours(TABLE(SELECT dst, src FROM sliced), 5, 42, 2)""")


@query("surface_mean", SQL["agg_mean"])
def surface_mean(spark, d):
    _surface(spark, d)
    return vec.long_form(spark.sql("SELECT node_id, h FROM g_mean()"), "h")


@query("surface_gcn_norm", SQL["agg_gcnnorm"])
def surface_gcn_norm(spark, d):
    _surface(spark, d)
    return vec.long_form(spark.sql("SELECT node_id, h FROM g_gcn_norm()"), "h")


@query("surface_gcn_norm_seeds", SQL["agg_gcnnorm"].replace("FROM y", "FROM y WHERE node_id % 25 = 0"))
def surface_gcn_norm_seeds(spark, d):
    _surface(spark, d)
    return vec.long_form(spark.sql("SELECT node_id, h FROM g_gcn_norm() WHERE node_id IN (SELECT node_id FROM g_seeds)"), "h")


@query("surface_batches", sql("nodes", "SELECT batch, count(*) AS rows, count(*) = 64 AS complete FROM (SELECT CAST(floor((row_number() OVER (ORDER BY node_id) - 1) / 64) AS BIGINT) AS batch FROM nodes) GROUP BY batch"))
def surface_batches(spark, d):
    _surface(spark, d)
    smp.batches(fx.nodes(spark, d), 64).withColumnRenamed("batch_id", "batch").createOrReplaceTempView("g_batches")
    return spark.sql("SELECT * FROM check_batches(TABLE(g_batches), 64)")


# ---- samples until they cover the nodes


def _covering_sql(batch: int, length: int, coverage: float, most: int) -> list[str]:
    """members(sample, node_id) of the first samples whose sizes reach the coverage; `most` samples are drawn. Batches of less than a quarter of the nodes."""
    out = [
        "ix AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM nodes)",
        "total AS (SELECT count(*) AS n FROM nodes)",
        f"drawn AS (SELECT sample, i, min(turn) AS turn FROM (SELECT sample, turn, {_pick(_unit(_tape('cover', 'sample', 'turn')), 'n')} AS i FROM total, unnest(CAST(range({most}) AS BIGINT[])) a(sample), unnest(CAST(range(1, {4 * batch + 33}) AS BIGINT[])) b(turn)) GROUP BY sample, i)",
        f"c0 AS (SELECT sample, node_id FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY turn) AS rn FROM drawn) JOIN ix USING (i) WHERE rn <= {batch})",
    ]
    for s in range(1, length + 1):
        out.append(f"c{s} AS (SELECT DISTINCT w.sample, coalesce(t.dest, w.node_id) AS node_id FROM c{s - 1} w LEFT JOIN (SELECT DISTINCT node, degree FROM slots) n ON n.node = w.node_id LEFT JOIN slots t ON t.node = w.node_id AND t.slot = {_pick(_unit(_tape(s, 'w.sample', 'w.node_id')), 'n.degree')})")
    return [
        *out,
        "every AS (" + " UNION ".join(f"SELECT sample, node_id FROM c{s}" for s in range(length + 1)) + ")",
        "upto AS (SELECT sample, n, sum(n) OVER (ORDER BY sample) AS total FROM (SELECT sample, count(*) AS n FROM every GROUP BY sample))",
        f"members AS (SELECT sample, node_id FROM every WHERE sample IN (SELECT sample FROM upto WHERE total - n < {coverage} * (SELECT n FROM total)))",
    ]


@query("saint_coverage", sql("g1 nodes", f"SELECT node_id, {_round('(SELECT max(sample) + 1.0::DOUBLE FROM members) / greatest(CAST(coalesce(c, 0) AS DOUBLE), 0.1::DOUBLE) / (SELECT n FROM total)', 9)} AS norm FROM nodes LEFT JOIN (SELECT node_id, count(*) AS c FROM members GROUP BY node_id) USING (node_id)", SLOTS.format(g="g1"), *_covering_sql(20, 2, 3.0, 80)))
def saint_coverage(spark, d):
    """Norms from samples that cover the nodes three times."""
    g = fx.graph(spark, d)
    samples = walks.covering_samples(g, 20, 2, 3.0)
    out = walks.node_norm(g.nodes, samples, samples.agg(F.max("sample")).first()[0] + 1)
    return out.select("node_id", rounded(F.col("norm"), 9).alias("norm"))


@query("saint_covering_samples", sql("g1 nodes", "SELECT sample, node_id FROM members", SLOTS.format(g="g1"), *_covering_sql(20, 2, 3.0, 80)))
def saint_covering_samples(spark, d):
    return walks.covering_samples(fx.graph(spark, d), 20, 2, 3.0)


# ---- over the graph stored in buckets


@query("stored_sample_2hop", SQL["sample_2hop"])
def stored_sample_2hop(spark, d):
    return smp.fanout(fx.stored(spark, d), fx.seeds(spark, d), [10, 5])[1]


@query("stored_sample_outgoing", SQL["sample_outgoing"])
def stored_sample_outgoing(spark, d):
    return smp.fanout(fx.stored(spark, d), fx.seeds(spark, d), [4, 3], direction="outgoing")[1]


@query("stored_gcn_infer_2hop", SQL["gcn_infer_2hop"])
def stored_gcn_infer_2hop(spark, d):
    return vec.long_form(infer(fx.stored(spark, d), fx.seeds(spark, d), gcn_spec()), "h")


@query("stored_degrees", SQL["degree_in"])
def stored_degrees(spark, d):
    return fx.stored(spark, d).degrees()


# ---- stacks of layers, first layers aggregated beforehand


def _stack() -> tuple[stack.Stack, dict]:
    t = gcn_spec().tensors
    names = {"a": "conv_0", "b": "conv_1", "c": "classifier"}
    return stack.Stack((stack.StackLayer("gcn", 8), stack.StackLayer("gcn", 8)), 10, "both", (10, 5)), {f"{names[k.split('.')[0]]}.{k.split('.')[1]}": v for k, v in t.items()}


@query("stack_infer", SQL["gcn_infer_full"])
def stack_infer(spark, d):
    model, tensors = _stack()
    return vec.long_form(infer(fx.graph(spark, d), None, model.spec(tensors)), "h")


@query("stack_preaggregated", SQL["gcn_infer_full"])
def stack_preaggregated(spark, d):
    """The first aggregation is computed and stored as the nodes' features; the model goes on from there."""
    g = fx.graph(spark, d)
    model, tensors = _stack()
    x = g.nodes.select("node_id", F.col("features").cast("array<double>").alias("h"))
    before = agg.gcn_norm(g.edges, x, g.degrees(), g.nodes, DIM).withColumnRenamed("h", "features")
    return vec.long_form(infer(PropertyGraph(before, g.edges), None, model.preaggregated(tensors)), "h")


_BUNDLE = ["degs AS (SELECT v.node_id, v.hop, count(s.src) AS d FROM visited v LEFT JOIN sampled s ON s.dst = v.node_id GROUP BY v.node_id, v.hop)", "inn AS (SELECT node_id FROM visited WHERE hop < 2)", f"pre AS ({gcn_sql('sampled', 'degs', 'x', 'inn')})"]


@query("sampled_bundle", sql("g1 x seeds", f"SELECT g.node_id, g.hop, g.d AS degree, x.dim, {_round('x.v')} AS x, {_round('p.v')} AS preagg, coalesce(CAST(e.label AS BIGINT), -1) AS target FROM degs g JOIN x ON x.node_id = g.node_id LEFT JOIN pre p ON p.node_id = g.node_id AND p.dim = x.dim LEFT JOIN embeddings e ON e.vec_id = g.node_id", *sample_ctes("g1", [10, 5]), *_BUNDLE))
def sampled_bundle(spark, d):
    out = feat.sampled_bundle(fx.graph(spark, d), fx.seeds(spark, d), [10, 5], DIM)
    rows = out.select("node_id", "hop", "degree", "target", F.posexplode("x").alias("dim", "x"), "preagg")
    return rows.select("node_id", "hop", "degree", F.col("dim").cast("long").alias("dim"), rounded(F.col("x")).alias("x"), rounded(F.col("preagg")[F.col("dim")]).alias("preagg"), "target")


# ---- smaller parts


@query("fetch_features_only", sql("nodes", f"SELECT o_orderkey AS pos, o_custkey AS node_id, {_round('CAST(embedding[1] AS DOUBLE)')} AS x0 FROM orders JOIN embeddings ON vec_id = o_custkey WHERE embedding IS NOT NULL"))
def fetch_features_only(spark, d):
    return feat.fetch(_requests(spark, d), fx.nodes(spark, d), labels=False).select("pos", "node_id", rounded(F.col("features")[0].cast("double")).alias("x0"))


@query("fetch_labels_only", "SELECT o_orderkey AS pos, o_custkey AS node_id, CAST(label AS BIGINT) AS target FROM orders JOIN embeddings ON vec_id = o_custkey")
def fetch_labels_only(spark, d):
    return feat.fetch(_requests(spark, d), fx.nodes(spark, d), features=False).select("pos", "node_id", F.col("target").cast("long").alias("target"))


@query("fetch_ids_only", "SELECT o_orderkey AS pos, o_custkey AS node_id FROM orders WHERE o_custkey IN (SELECT vec_id FROM embeddings)")
def fetch_ids_only(spark, d):
    return feat.fetch(_requests(spark, d), fx.nodes(spark, d), features=False, labels=False)


@query("map_merge", """SELECT l_orderkey AS id, CASE WHEN bool_or(l_linestatus = 'F') THEN max(l_partkey) FILTER (WHERE l_linestatus = 'F') ELSE max(l_suppkey) END AS f,
CASE WHEN bool_or(l_linestatus = 'O') THEN max(l_partkey) FILTER (WHERE l_linestatus = 'O') ELSE NULL END AS o, max(l_suppkey) AS rest FROM lineitem GROUP BY l_orderkey""")
def map_merge(spark, d):
    """Maps with the keys F (and rest), and by line status; the second one's values win."""
    rows = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), "l_linestatus").agg(F.max("l_partkey").alias("v"), F.max("l_suppkey").alias("s"))
    maps = rows.groupBy("id").agg(F.create_map(F.lit("F"), F.max("s"), F.lit("rest"), F.max("s")).alias("a"), F.map_from_entries(F.collect_list(F.struct("l_linestatus", "v"))).alias("b"))
    m = vec.map_merge(F.col("a"), F.col("b"))
    return maps.select("id", F.try_element_at(m, F.lit("F")).alias("f"), F.try_element_at(m, F.lit("O")).alias("o"), F.try_element_at(m, F.lit("rest")).alias("rest"))


@query("sample_order_agreement", sql("g1 seeds", "SELECT coalesce(a.i, b.i) AS place, a.node_id AS first, b.node_id AS second FROM la a FULL JOIN lb b ON a.i = b.i WHERE a.node_id IS DISTINCT FROM b.node_id", *sample_ctes("g1", [4, 3]),
    "la AS (SELECT node_id, row_number() OVER (ORDER BY hop, node_id) - 1 AS i FROM visited)", "lb AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM (SELECT src AS node_id FROM sampled UNION SELECT dst FROM sampled UNION SELECT node_id FROM seeds))"))
def sample_order_agreement(spark, d):
    """A sample's nodes in order of hops against the same nodes in order of ids."""
    nodes, edges = smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [4, 3])
    by_id = smp.remap_with_seeds(edges.select(F.explode(F.array("src", "dst")).alias("node_id")), fx.seeds(spark, d))
    return smp.order_agreement(smp.relabel(nodes, edges)[0], by_id)


# ---- paths drawn by their numbers


@query("counted_paths", sql("g1 seeds", "SELECT root, draw, 0 AS step, s1 AS src, root AS dst FROM chosen UNION ALL SELECT root, draw, 1, s2, s1 FROM chosen WHERE s2 IS NOT NULL",
    "p AS (SELECT s.node_id AS root, 1 AS left_, a.src AS s1, CAST(NULL AS BIGINT) AS s2 FROM seeds s JOIN g1 a ON a.dst = s.node_id UNION ALL SELECT s.node_id, 2, a.src, b.src FROM seeds s JOIN g1 a ON a.dst = s.node_id JOIN g1 b ON b.dst = a.src)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY left_, s1, s2) - 1 AS rank, count(*) OVER (PARTITION BY root) AS total FROM p)",
    f"draws AS (SELECT root, rank, min(i) AS draw FROM (SELECT root, i, CASE WHEN total <= 20 THEN i ELSE {_pick(_unit(_tape('paths', 'root', 'i')), 'total')} END AS rank FROM (SELECT DISTINCT root, total FROM ranked), unnest(CAST(range(20) AS BIGINT[])) t(i) WHERE i < total) GROUP BY root, rank)",
    f"chosen AS (SELECT * FROM (SELECT d.root, d.draw, r.s1, r.s2, row_number() OVER (PARTITION BY d.root ORDER BY {_tape('turn', 'd.root', 'd.rank')}, d.draw) AS rn FROM draws d JOIN ranked r ON r.root = d.root AND r.rank = d.rank) WHERE rn <= 6)"))
def counted_paths(spark, d):
    return adj.counted_paths(fx.graph(spark, d), fx.seeds(spark, d), 2, 6)


# ---- aggregation by blocks


@query("block_mean", SQL["agg_mean"])
def block_mean(spark, d):
    g = fx.graph(spark, d)
    return vec.long_form(blocks.mean_or_self(g.edges, _vectors(g), g.nodes, DIM, (3, 2)), "h")


@query("block_gcn_norm", SQL["agg_gcnnorm"])
def block_gcn_norm(spark, d):
    g = fx.graph(spark, d)
    return vec.long_form(blocks.gcn_norm(g.edges, _vectors(g), g.degrees(), g.nodes, DIM), "h")


def _vectors(g: PropertyGraph):
    return g.nodes.select("node_id", F.col("features").cast("array<double>").alias("h"))


# ---- balanced partitions


def _balanced_sql(parts: int, rounds: int) -> list[str]:
    out = ["pw AS (SELECT src, dst, 1 + (src + dst) % 3 AS weight FROM und1)", f"b0 AS (SELECT node_id, (row_number() OVER (ORDER BY node_id) - 1) % {parts} AS part FROM nodes)", f"cap AS (SELECT CAST(ceil(count(*) * 105 / (100.0 * {parts})) AS BIGINT) AS c FROM nodes)"]
    for r in range(1, rounds + 1):
        t = _tape(f"b{r}", "node_id")
        out += [
            f"ld{r} AS (SELECT p.part, count(node_id) AS load FROM (SELECT unnest(range({parts})) AS part) p LEFT JOIN b{r - 1} USING (part) GROUP BY p.part)",
            f"sc{r} AS (SELECT v.node_id, v.part, o.part AS own, l.load, v.votes * (2 * c - l.load) AS score FROM (SELECT e.dst AS node_id, b.part, sum(weight) AS votes FROM pw e JOIN b{r - 1} b ON b.node_id = e.src GROUP BY e.dst, b.part) v JOIN b{r - 1} o ON o.node_id = v.node_id JOIN ld{r} l ON l.part = v.part, cap WHERE substr({t.replace('node_id', 'v.node_id')}, 1, 1) < '8')",
            f"ch{r} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, part <> own, part) AS rn FROM sc{r}) WHERE rn = 1 AND part <> own)",
            f"mv{r} AS (SELECT node_id, part FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY {t}) - 1 AS place FROM ch{r}), cap WHERE place < c - load)",
            f"b{r} AS (SELECT b.node_id, coalesce(m.part, b.part) AS part FROM b{r - 1} b LEFT JOIN mv{r} m USING (node_id))",
        ]
    return out


def _weighted_pairs(g: PropertyGraph):
    return g.view("undirected").withColumn("weight", 1 + (F.col("src") + F.col("dst")) % 3)


@query("balanced_partition", sql("g1 und1 nodes", "SELECT node_id, part FROM b3", *_balanced_sql(4, 3)))
def balanced_partition(spark, d):
    g = fx.graph(spark, d)
    return partition.balanced_parts(g.nodes, _weighted_pairs(g), 4, 3)


@query("balanced_cut", sql("g1 und1 nodes", " UNION ALL ".join(
    f"SELECT '{name}' AS how, (SELECT CAST(sum(CASE WHEN a.part <> b.part THEN weight ELSE 0 END) AS BIGINT) FROM pw e JOIN {t} a ON a.node_id = e.src JOIN {t} b ON b.node_id = e.dst) AS cut, (SELECT CAST(sum(weight) AS BIGINT) FROM pw) AS total, (SELECT {_round('max(n) / avg(n)')} FROM (SELECT count(*) AS n FROM {t} GROUP BY part)) AS balance" for name, t in (("rounds", "b6"), ("modulo", "b0"))), *_balanced_sql(4, 6)))
def balanced_cut(spark, d):
    """Weight across four parts after six rounds, and by ids modulo four."""
    g = fx.graph(spark, d)
    pairs = _weighted_pairs(g)
    out = None
    for how, rounds in (("rounds", 6), ("modulo", 0)):
        one = partition.weighted_cut(pairs, partition.balanced_parts(g.nodes, pairs, 4, rounds)).select(F.lit(how).alias("how"), "cut", "total", rounded(F.col("balance")).alias("balance"))
        out = one if out is None else out.unionByName(one)
    return out
