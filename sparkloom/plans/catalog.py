"""Queries of the engine, each with SQL of the same result where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import vectors as vec
from sparkloom.functions.lineage import scratch
from sparkloom.functions.tape import tape
from sparkloom.graph import PropertyGraph, disagreement, upsert_nodes
from sparkloom.operators import aggregate as agg
from sparkloom.operators import caches
from sparkloom.operators import divergence as div
from sparkloom.operators import events as ev
from sparkloom.operators import features as feat
from sparkloom.operators import sampling as smp
from sparkloom.operators import walks
from sparkloom.plans import fixtures as fx
from sparkloom.plans.fixtures import DIM, sql
from sparkloom.plans.batched import infer_batches
from sparkloom.plans.planner import dense, infer, predict
from sparkloom.plans.spec import Layer, ModelSpec, compile_layers
from sparkloom.plans.store import list_models, load_model, save_model
from sparkloom.sources import readers

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return keep


def _tape(step: object, *keys: str, seed: int = 42) -> str:
    return f"md5(concat_ws(':', '{seed}', '{step}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


def _u(h: str) -> str:
    return f"(CAST('0x' || substr({h}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _key(h: str, weight: str) -> str:
    return f"(-ln({_u(h)} + {2.0**-33!r}::DOUBLE) / {weight})"


def _round(x: str, digits: int = 6) -> str:
    return f"CASE WHEN round({x}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({x}, {digits}) END"


def rounded(x, digits: int = 6):
    y = F.round(x, digits)
    return F.when(y == 0, F.lit(0.0)).otherwise(y)


def sample_ctes(g: str, fanouts: list[int], revisit: bool = False) -> list[str]:
    out = ["f0 AS (SELECT node_id FROM seeds)", "v0 AS (SELECT node_id, 0 AS hop FROM f0)"]
    for h, k in enumerate(fanouts, 1):
        ranked = f"SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.dst ORDER BY {_tape(h, 'e.dst', 'e.src')}) AS rn FROM {g} e JOIN f{h - 1} f ON e.dst = f.node_id"
        out += [
            f"s{h} AS (SELECT {h} AS hop, src, dst FROM ({ranked}) {f'WHERE rn <= {k}' if k >= 0 else ''})",
            f"reach{h} AS (SELECT DISTINCT src AS node_id FROM s{h})",
            f"n{h} AS (SELECT node_id FROM reach{h} WHERE node_id NOT IN (SELECT node_id FROM v{h - 1}))",
            f"f{h} AS (SELECT node_id FROM {'reach' if revisit else 'n'}{h})",
            f"v{h} AS (SELECT * FROM v{h - 1} UNION ALL SELECT node_id, {h} FROM n{h})",
        ]
    last = len(fanouts)
    return [*out, "sampled AS (" + " UNION ALL ".join(f"SELECT * FROM s{h}" for h in range(1, last + 1)) + ")", f"visited AS (SELECT * FROM v{last})"]


# ---- sources, seeds, scans


@query("node_count", sql("nodes", "SELECT split, count(*) AS n FROM nodes GROUP BY split"))
def node_count(spark, d):
    return fx.nodes(spark, d).groupBy("split").agg(F.count("*").alias("n"))


@query("node_upsert", """
WITH base AS (SELECT c_custkey AS node_id, c_acctbal AS value, CAST(1 AS BIGINT) AS version FROM customer),
fresh AS (SELECT o_custkey AS node_id, o_totalprice AS value, o_orderkey + 2 AS version FROM orders)
SELECT node_id, value, version FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY version DESC) AS rn FROM (SELECT * FROM base UNION ALL SELECT * FROM fresh)) WHERE rn = 1""")
def node_upsert(spark, d):
    base = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("value"), F.lit(1).cast("long").alias("version"))
    fresh = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("node_id"), F.col("o_totalprice").alias("value"), (F.col("o_orderkey") + 2).alias("version"))
    return upsert_nodes(base, fresh)


@query("edge_ingest_dedup", sql("g1", "SELECT src, dst FROM g1 WHERE src IN (SELECT vec_id FROM embeddings) AND dst IN (SELECT vec_id FROM embeddings)"))
def edge_ingest_dedup(spark, d):
    return fx.ingested(spark, d)


@query("hetero_edges", """
SELECT 'PLACED' AS etype, o_custkey AS src, o_orderkey AS dst FROM orders
UNION ALL SELECT DISTINCT 'CONTAINS', l_orderkey, l_partkey FROM lineitem
UNION ALL SELECT DISTINCT 'SUPPLIES', l_suppkey, l_partkey FROM lineitem""")
def hetero_edges(spark, d):
    line = fx.table(spark, d, "lineitem")
    placed = fx.table(spark, d, "orders").select(F.lit("PLACED").alias("etype"), F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    contains = line.select(F.lit("CONTAINS").alias("etype"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    supplies = line.select(F.lit("SUPPLIES").alias("etype"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return placed.unionByName(contains).unionByName(supplies)


@query("split_exact", f"""
WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY {_tape('split', 'vec_id')}, vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)
SELECT vec_id AS node_id, CASE WHEN i < floor(0.6 * n) THEN 'train' WHEN i < floor(0.8 * n) THEN 'val' ELSE 'test' END AS split FROM r""")
def split_exact(spark, d):
    rows = fx.nodes(spark, d).select("node_id", tape(42, "split", "node_id").alias("t"))
    n = rows.count()
    i = F.col("local_id")
    return smp.dense_index(rows, "t", "node_id").select("node_id", F.when(i < int(0.6 * n), "train").when(i < int(0.8 * n), "val").otherwise("test").alias("split"))


@query("label_nan", "SELECT event_id, CASE WHEN v IS NULL OR isnan(v) THEN -1.0::DOUBLE ELSE v END AS label FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'nan'::DOUBLE WHEN event_type = 'signup' THEN NULL ELSE value END AS v FROM events)")
def label_nan(spark, d):
    v = F.when(F.col("event") == "error", F.lit(float("nan"))).when(F.col("event") == "signup", F.lit(None).cast("double")).otherwise(F.col("value"))
    rows = fx.log(spark, d).select("event_id", v.alias("v"))
    return rows.select("event_id", F.when(F.col("v").isNull() | F.isnan("v"), F.lit(-1.0)).otherwise(F.col("v")).alias("label"))


@query("seed_split", sql("nodes", "SELECT node_id FROM nodes WHERE split = 'val' ORDER BY node_id LIMIT 50"))
def seed_split(spark, d):
    return smp.split_seeds(fx.nodes(spark, d), "val", limit=50)


@query("seed_split_limit_skip", sql("nodes", "SELECT node_id FROM (SELECT node_id FROM nodes WHERE split = 'train' ORDER BY node_id LIMIT 60) ORDER BY node_id OFFSET 20"))
def seed_split_limit_skip(spark, d):
    return smp.split_seeds(fx.nodes(spark, d), "train", limit=60, offset=20)


@query("seed_page", sql("nodes", "SELECT node_id FROM nodes WHERE split = 'train' ORDER BY node_id LIMIT 60 OFFSET 20"))
def seed_page(spark, d):
    return smp.page(fx.nodes(spark, d), "train", 60, 20)


@query("seed_shuffle", sql("nodes", f"SELECT node_id FROM nodes WHERE split = 'train' ORDER BY {_tape('s', 'node_id')} LIMIT 40"))
def seed_shuffle(spark, d):
    return smp.split_seeds(fx.nodes(spark, d), "train", limit=40, shuffle=True)


@query("seed_partition", sql("nodes", "SELECT node_id FROM nodes WHERE split = 'train' AND node_id % 4 = 1 ORDER BY node_id LIMIT 30"))
def seed_partition(spark, d):
    parts = feat.partition_ids(fx.nodes(spark, d), 4).where("part = 1").select("node_id")
    return smp.split_seeds(fx.nodes(spark, d).join(parts, "node_id", "left_semi"), "train", limit=30)


@query("seeds_ordered", "SELECT pos, node_id FROM (SELECT o_orderkey AS pos, o_custkey AS node_id FROM orders) WHERE node_id IN (SELECT vec_id FROM embeddings)")
def seeds_ordered(spark, d):
    return smp.ordered_lookup(_requests(spark, d), fx.nodes(spark, d))


def _requests(spark, d):
    """Requests for nodes, some of which don't exist: a customer's for each order."""
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("node_id"))


@query("seed_random_test", sql("nodes", f"SELECT node_id FROM nodes WHERE split = 'test' ORDER BY {_tape('rt', 'node_id', seed=10071)} LIMIT 64"))
def seed_random_test(spark, d):
    run, n = 1, 64
    return fx.nodes(spark, d).where("split = 'test'").select("node_id").orderBy(tape(run * 10007 + n, "rt", "node_id")).limit(n)


@query("seed_all_labelled", sql("nodes", "SELECT node_id, split FROM nodes WHERE target IS NOT NULL AND split IN ('train', 'val', 'test')"))
def seed_all_labelled(spark, d):
    n = fx.nodes(spark, d).where(F.col("target").isNotNull())
    parts = [n.where(F.col("split") == s).select("node_id", "split") for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("seed_shard", sql("nodes", f"SELECT node_id FROM (SELECT node_id, row_number() OVER (ORDER BY {_tape('d', 'node_id')}, node_id) - 1 AS i FROM nodes WHERE split = 'train') WHERE i % 3 = 1"))
def seed_shard(spark, d):
    return smp.shard(fx.nodes(spark, d).where("split = 'train'"), 1, 3)


@query("minibatch_ids", sql("nodes", "SELECT node_id, CAST(floor((row_number() OVER (ORDER BY node_id) - 1) / 64) AS BIGINT) AS batch_id FROM nodes WHERE split = 'train'"))
def minibatch_ids(spark, d):
    return smp.batches(fx.nodes(spark, d).where("split = 'train'"), 64)


@query("minibatch_drop_last", sql("nodes", "SELECT node_id, b AS batch_id FROM (SELECT *, count(*) OVER (PARTITION BY b) AS c FROM (SELECT node_id, CAST(floor((row_number() OVER (ORDER BY node_id) - 1) / 64) AS BIGINT) AS b FROM nodes WHERE split = 'train')) WHERE c = 64"))
def minibatch_drop_last(spark, d):
    return smp.batches(fx.nodes(spark, d).where("split = 'train'"), 64, drop_last=True)


@query("point_lookup", sql("nodes", "SELECT node_id, target FROM nodes WHERE node_id IN (SELECT s_suppkey FROM supplier)"))
def point_lookup(spark, d):
    """The nodes asked for by a table of ids."""
    ids = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"))
    return fx.nodes(spark, d).join(ids, "node_id").select("node_id", "target")


# ---- gather and labels


@query("degree_in", sql("g1 deg1", "SELECT node_id, d AS degree FROM deg1"))
def degree_in(spark, d):
    return fx.graph(spark, d).degrees()


@query("degree_out_topk", sql("g1", "SELECT src AS node_id, count(*) AS degree FROM g1 GROUP BY src ORDER BY degree DESC, node_id LIMIT 20"))
def degree_out_topk(spark, d):
    return feat.top_out_degree(fx.graph(spark, d), 20)


@query("fetch_xy", f"""SELECT pos, node_id, {_round('CAST(embedding[1] AS DOUBLE)')} AS x0, {_round('CAST(embedding[64] AS DOUBLE)')} AS x63, CAST(label AS BIGINT) AS target
FROM (SELECT o_orderkey AS pos, o_custkey AS node_id FROM orders) JOIN embeddings ON vec_id = node_id""")
def fetch_xy(spark, d):
    out = feat.fetch(_requests(spark, d), fx.nodes(spark, d))
    return out.select("pos", "node_id", rounded(F.col("features")[0].cast("double")).alias("x0"), rounded(F.col("features")[63].cast("double")).alias("x63"), F.col("target").cast("long").alias("target"))


@query("gather_dense", f"""SELECT pos, node_id, CAST(k - 1 AS BIGINT) AS dim, {_round('coalesce(CAST(embedding[k] AS DOUBLE), 0.0)')} AS h, coalesce(CAST(label AS BIGINT), -1) AS target
FROM (SELECT o_orderkey AS pos, o_custkey AS node_id FROM orders) LEFT JOIN embeddings ON vec_id = node_id, unnest(range(1, 65)) u(k)""")
def gather_dense(spark, d):
    return vec.long_form(feat.gather(_requests(spark, d), fx.nodes(spark, d), DIM), "h")


@query("gather_cached", sql("g1", """SELECT r.pos, r.node_id, h.node_id IS NOT NULL AS hit FROM (SELECT o_orderkey AS pos, o_custkey AS node_id FROM orders) r
LEFT JOIN (SELECT src AS node_id FROM g1 GROUP BY src ORDER BY count(*) DESC, src LIMIT 100) h ON h.node_id = r.node_id"""))
def gather_cached(spark, d):
    hot = feat.top_out_degree(fx.graph(spark, d), 100)
    return feat.gather_cached(_requests(spark, d), hot, fx.nodes(spark, d), DIM).select("pos", "node_id", "hit")


@query("label_encode_sorted", "SELECT event_id AS node_id, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def label_encode_sorted(spark, d):
    return feat.encode_labels(fx.log(spark, d).select(F.col("event_id").alias("node_id"), F.col("event").alias("target")))


@query("codec_roundtrip", f"SELECT vec_id AS node_id, CAST(64 * 4 AS BIGINT) AS bytes, {_round('CAST(embedding[3] AS DOUBLE)')} AS x2, CAST(label AS BIGINT) AS label FROM embeddings")
def codec_roundtrip(spark, d):
    rows = fx.nodes(spark, d).select("node_id", vec.pack_floats("features").alias("b"), vec.pack_label(F.col("target").cast("long")).alias("y"))
    return rows.select("node_id", F.length("b").cast("long").alias("bytes"), rounded(vec.unpack_floats("b")[2].cast("double")).alias("x2"), vec.unpack_label("y").alias("label"))


# ---- neighbour sampling


@query("sample_1hop", sql("g1 seeds", "SELECT hop, src, dst FROM sampled", *sample_ctes("g1", [10])))
def sample_1hop(spark, d):
    return smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [10])[1]


@query("sample_2hop", sql("g1 seeds", "SELECT hop, src, dst FROM sampled", *sample_ctes("g1", [10, 5])))
def sample_2hop(spark, d):
    return smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [10, 5])[1]


@query("sample_3hop_sparse", sql("g1 seeds", "SELECT hop, src, dst FROM sampled", *sample_ctes("g1", [3, 3, 2])))
def sample_3hop_sparse(spark, d):
    return smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [3, 3, 2])[1]


@query("sample_takeall", sql("g1 seeds", "SELECT hop, src, dst FROM sampled", *sample_ctes("g1", [-1, -1])))
def sample_takeall(spark, d):
    return smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [-1, -1])[1]


@query("sample_nodes_by_hop", sql("g1 seeds", "SELECT node_id, hop FROM visited", *sample_ctes("g1", [10, 5])))
def sample_nodes_by_hop(spark, d):
    return smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [10, 5])[0]


@query("sample_frontier", sql("g1 seeds", "SELECT node_id FROM visited WHERE hop = (SELECT max(hop) FROM visited WHERE hop > 0)", *sample_ctes("g1", [2, 2])))
def sample_frontier(spark, d):
    return smp.last_frontier(smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [2, 2])[0])


@query("sample_expand_revisited", sql("g1 seeds", "SELECT hop, src, dst FROM sampled", *sample_ctes("g1", [4, 3], revisit=True)))
def sample_expand_revisited(spark, d):
    return smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [4, 3], expand_revisited=True)[1]


@query("sample_outgoing", sql("g1 seeds", "SELECT hop, src, dst FROM sampled", "out2 AS (SELECT dst AS src, src AS dst FROM g1)", *sample_ctes("out2", [4, 3])))
def sample_outgoing(spark, d):
    return smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [4, 3], direction="outgoing")[1]


@query("sample_undirected", sql("g1 und1 seeds", "SELECT hop, src, dst FROM sampled", *sample_ctes("und1", [4, 3])))
def sample_undirected(spark, d):
    return smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [4, 3], direction="undirected")[1]


@query("sample_labelled", sql("g1 seeds nodes", "SELECT hop, src, dst FROM sampled", "lab2 AS (SELECT g1.* FROM g1 JOIN nodes ON src = node_id WHERE target % 2 = 0)", *sample_ctes("lab2", [4, 3])))
def sample_labelled(spark, d):
    g = fx.graph(spark, d)
    g = PropertyGraph(g.nodes.withColumn("label", F.when(F.col("target") % 2 == 0, "even").otherwise("odd")), g.edges)
    return smp.fanout(g, fx.seeds(spark, d), [4, 3], neighbor_label="even")[1]


@query("sample_induced", sql("g1 seeds", "SELECT DISTINCT src, dst FROM (SELECT src, dst FROM inn UNION ALL SELECT dst, src FROM inn)", *sample_ctes("g1", [3, 2]),
    "inn AS (SELECT src, dst FROM g1 WHERE src IN (SELECT node_id FROM visited) AND dst IN (SELECT node_id FROM visited))"))
def sample_induced(spark, d):
    return smp.induced_sample(fx.graph(spark, d), fx.seeds(spark, d), [3, 2])


@query("sample_uniform_disjoint", sql("g1 und1 seeds", "SELECT 1 AS hop, root, src, dst FROM d1 UNION ALL SELECT 2, root, src, dst FROM d2",
    f"d1 AS (SELECT root, src, dst FROM (SELECT s.node_id AS root, e.src, e.dst, row_number() OVER (PARTITION BY s.node_id, e.dst ORDER BY {_tape(1, 's.node_id', 'e.dst', 'e.src')}) AS rn FROM und1 e JOIN seeds s ON e.dst = s.node_id WHERE e.src <> s.node_id) WHERE rn <= 3)",
    "w1 AS (SELECT DISTINCT root, src AS node_id FROM d1)",
    f"d2 AS (SELECT root, src, dst FROM (SELECT w.root, e.src, e.dst, row_number() OVER (PARTITION BY w.root, e.dst ORDER BY {_tape(2, 'w.root', 'e.dst', 'e.src')}) AS rn FROM und1 e JOIN w1 w ON e.dst = w.node_id WHERE e.src <> w.root AND NOT EXISTS (SELECT 1 FROM w1 v WHERE v.root = w.root AND v.node_id = e.src)) WHERE rn <= 2)"))
def sample_uniform_disjoint(spark, d):
    return smp.disjoint(fx.graph(spark, d), fx.seeds(spark, d), [3, 2])


@query("sample_replacement", sql("g1 seeds", f"""SELECT k.dst, k.draw, r.src FROM (SELECT dst, n, draw, CAST(floor({_u(_tape('r', 'dst', 'draw'))} * n) AS BIGINT) AS i FROM sizes, unnest(range(1, 6)) t(draw)) k
JOIN ranked r ON r.dst = k.dst AND r.i = k.i""",
    "ranked AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS i FROM g1 WHERE dst IN (SELECT node_id FROM seeds))", "sizes AS (SELECT dst, count(*) AS n FROM ranked GROUP BY dst)"))
def sample_replacement(spark, d):
    return smp.with_replacement(fx.graph(spark, d), fx.seeds(spark, d), 5)


@query("sample_paths", sql("g1 seeds", "SELECT root, CAST(step - 1 AS BIGINT) AS step, CAST(split_part(used[step], '>', 2) AS BIGINT) AS src, CAST(split_part(used[step], '>', 1) AS BIGINT) AS dst FROM chosen, unnest(range(1, CAST(len(used) + 1 AS BIGINT))) t(step)",
    "p1 AS (SELECT s.node_id AS root, e.src AS here, [concat_ws('>', e.dst, e.src)] AS used FROM seeds s JOIN g1 e ON e.dst = s.node_id)",
    "p2 AS (SELECT root, e.src AS here, list_append(used, concat_ws('>', e.dst, e.src)) AS used FROM p1 JOIN g1 e ON e.dst = p1.here WHERE NOT list_contains(used, concat_ws('>', e.dst, e.src)))",
    f"chosen AS (SELECT root, used FROM (SELECT root, used, row_number() OVER (PARTITION BY root ORDER BY {_tape('p', 'root', 'array_to_string(used, chr(124))')}) AS rn FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)) WHERE rn <= 6)"))
def sample_paths(spark, d):
    return smp.paths(fx.graph(spark, d), fx.seeds(spark, d), 2, 6)


@query("relabel_edge_index", sql("g1 seeds", "SELECT e.hop, e.src, e.dst, a.i AS local_src, b.i AS local_dst FROM sampled e JOIN loc a ON a.node_id = e.src JOIN loc b ON b.node_id = e.dst", *sample_ctes("g1", [10, 5]),
    "loc AS (SELECT node_id, row_number() OVER (ORDER BY hop, node_id) - 1 AS i FROM visited)"))
def relabel_edge_index(spark, d):
    return smp.relabel(*smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [10, 5]))[1].select("hop", "src", "dst", "local_src", "local_dst")


@query("remap_isolated_seeds", sql("g1 seeds", "SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS local_id FROM (SELECT src AS node_id FROM sampled UNION SELECT dst FROM sampled UNION SELECT node_id FROM seeds)", *sample_ctes("g1", [2])))
def remap_isolated_seeds(spark, d):
    edges = smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [2])[1]
    return smp.remap_with_seeds(edges.select(F.explode(F.array("src", "dst")).alias("node_id")), fx.seeds(spark, d))


@query("induced_subgraph", sql("g1 nodes", "SELECT e.src, e.dst, a.target AS src_target, b.target AS dst_target FROM g1 e JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.split = 'train' AND b.split = 'train'"))
def induced_subgraph(spark, d):
    g = fx.graph(spark, d)
    g = g.induced(g.nodes.where("split = 'train'"))
    y = g.nodes.select("node_id", "target")
    return g.edges.join(y.select(F.col("node_id").alias("src"), F.col("target").alias("src_target")), "src").join(y.select(F.col("node_id").alias("dst"), F.col("target").alias("dst_target")), "dst").select("src", "dst", "src_target", "dst_target")


@query("sample_agreement", sql("g1 seeds", "SELECT src, dst, 'first' AS side FROM (SELECT src, dst FROM sampled EXCEPT ALL SELECT src, dst FROM g1 WHERE dst IN (SELECT node_id FROM seeds)) UNION ALL SELECT src, dst, 'second' FROM (SELECT src, dst FROM g1 WHERE dst IN (SELECT node_id FROM seeds) EXCEPT ALL SELECT src, dst FROM sampled)", *sample_ctes("g1", [2])))
def sample_agreement(spark, d):
    g, s = fx.graph(spark, d), fx.seeds(spark, d)
    return smp.agreement(smp.fanout(g, s, [2])[1], smp.fanout(g, s, [-1])[1])


# ---- global, layer-wise and walk samplers


@query("uniform_node", sql("nodes", f"SELECT node_id FROM nodes ORDER BY {_tape('root', 'node_id')}, node_id LIMIT 50"))
def uniform_node(spark, d):
    return walks.roots(fx.nodes(spark, d), 50)


@query("uniform_edge", sql("g1", f"SELECT src, dst FROM g1 ORDER BY {_tape('ue', 'src', 'dst')}, src, dst LIMIT 200"))
def uniform_edge(spark, d):
    return walks.uniform_edges(fx.graph(spark, d), 200)


@query("fastgcn", sql("g1 deg1", f"SELECT node_id FROM deg1 WHERE d > 0 ORDER BY {_key(_tape('w', 'node_id'), 'CAST(d AS DOUBLE)')}, node_id LIMIT 60"))
def fastgcn(spark, d):
    return walks.weighted_nodes(fx.graph(spark, d).degrees().select("node_id", F.col("degree").cast("double").alias("weight")), 60)


@query("ladies", sql("g1 deg1 seeds", "SELECT 0 AS layer, node_id FROM seeds UNION ALL SELECT 1, node_id FROM l1 UNION ALL SELECT 2, node_id FROM l2",
    *[x for i, prev, k in ((1, "seeds", 40), (2, "l1", 30)) for x in (
        f"m{i} AS (SELECT e.src AS node_id, round(sum(1.0::DOUBLE / d.d), 9) AS w FROM g1 e JOIN {prev} p ON e.dst = p.node_id JOIN deg1 d ON d.node_id = e.dst GROUP BY e.src)",
        f"l{i} AS (SELECT node_id FROM m{i} WHERE w > 0 ORDER BY {_key(_tape(f'l{i}', 'node_id'), 'w')}, node_id LIMIT {k})")]))
def ladies(spark, d):
    return walks.layer_dependent(fx.graph(spark, d), fx.seeds(spark, d), [40, 30])


def walk_ctes(g: str, start: str, length: int, *, back: bool = True, weight: str | None = None, seed: int = 42, name: str = "w") -> list[str]:
    out = [f"{name}0 AS (SELECT node_id AS walker, node_id AS here, CAST(NULL AS BIGINT) AS prev FROM {start})"]
    for s in range(1, length + 1):
        t = _tape(s, f"{name}.walker", "e.src", seed=seed)
        order = _key(t, weight) if weight else t
        ban = f" WHERE {name}.prev IS NULL OR e.src <> {name}.prev" if not back else ""
        out += [
            f"{name}c{s} AS (SELECT walker, dest FROM (SELECT {name}.walker, e.src AS dest, row_number() OVER (PARTITION BY {name}.walker ORDER BY {order}, e.src) AS rn FROM {name}{s - 1} {name} JOIN {g} e ON e.dst = {name}.here{ban}) WHERE rn = 1)",
            f"{name}{s} AS (SELECT a.walker, coalesce(c.dest, a.here) AS here, CASE WHEN c.dest IS NOT NULL THEN a.here ELSE a.prev END AS prev FROM {name}{s - 1} a LEFT JOIN {name}c{s} c ON c.walker = a.walker)",
        ]
    return [*out, f"{name} AS (" + " UNION ALL ".join(f"SELECT walker, {s} AS step, here AS node_id FROM {name}{s}" for s in range(length + 1)) + ")"]


@query("random_walk", sql("g1 seeds", "SELECT walker, step, node_id FROM w", *walk_ctes("g1", "seeds", 4)))
def random_walk(spark, d):
    return walks.walk(fx.graph(spark, d), fx.seeds(spark, d), 4)


@query("random_walk_nb", sql("g1 und1 seeds", "SELECT walker, step, node_id FROM w", *walk_ctes("und1", "seeds", 4, back=False)))
def random_walk_nb(spark, d):
    g = fx.graph(spark, d)
    return walks.walk(PropertyGraph(g.nodes, g.view("undirected")), fx.seeds(spark, d), 4, backtrack=False)


@query("biased_walk", sql("g1 seeds", "SELECT walker, step, node_id FROM w", *walk_ctes("g1", "seeds", 4, weight="CAST(1 + (e.src * 7 + e.dst) % 5 AS DOUBLE)")))
def biased_walk(spark, d):
    return walks.walk(fx.graph(spark, d), fx.seeds(spark, d), 4, weight=(1 + (F.col("src") * 7 + F.col("dst")) % 5).cast("double"))


@query("coalesced_walk", sql("g1 seeds", "SELECT walker, 0 AS step, walker AS node_id FROM c0 UNION ALL SELECT walker, 1, here FROM c1 UNION ALL SELECT walker, 2, here FROM c2",
    "c0 AS (SELECT node_id AS walker, node_id AS here FROM seeds)",
    *[f"c{s} AS (SELECT a.walker, coalesce(b.dest, a.here) AS here FROM c{s - 1} a LEFT JOIN (SELECT dst, src AS dest FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY {_tape(s, 'dst', 'src')}) AS rn FROM g1) WHERE rn = 1) b ON b.dst = a.here)" for s in (1, 2)]))
def coalesced_walk(spark, d):
    return walks.walk(fx.graph(spark, d), fx.seeds(spark, d), 2, coalesce=True)


@query("pinsage_topk", sql("g1 und1 seeds", "SELECT root, node_id, visits FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY visits DESC, node_id) AS rn FROM counts) WHERE rn <= 4",
    *[x for i in range(4) for x in walk_ctes("und1", "seeds", 3, seed=100 + i, name=f"k{i}")],
    "counts AS (SELECT walker AS root, node_id, count(*) AS visits FROM (" + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(4)) + ") WHERE step > 0 AND node_id <> walker GROUP BY walker, node_id)"))
def pinsage_topk(spark, d):
    g = fx.graph(spark, d)
    g = PropertyGraph(g.nodes, g.view("undirected"))
    return walks.most_visited(walks.visit_counts([walks.walk(g, fx.seeds(spark, d), 3, seed=100 + i) for i in range(4)]), 4).select("root", "node_id", "visits")


@query("saint_node", sql("g1 deg1", f"SELECT node_id FROM deg1 WHERE d > 0 ORDER BY {_key(_tape('w', 'node_id'), 'CAST(d * d AS DOUBLE)')}, node_id LIMIT 60"))
def saint_node(spark, d):
    return walks.weighted_nodes(fx.graph(spark, d).degrees().select("node_id", (F.col("degree") * F.col("degree")).cast("double").alias("weight")), 60)


@query("saint_edge", sql("g1 deg1", f"SELECT src, dst FROM (SELECT e.src, e.dst, 1.0::DOUBLE / greatest(a.d, 1) + 1.0::DOUBLE / greatest(b.d, 1) AS w FROM g1 e JOIN deg1 a ON a.node_id = src JOIN deg1 b ON b.node_id = dst) ORDER BY {_key(_tape('e', 'src', 'dst'), 'w')}, src, dst LIMIT 100"))
def saint_edge(spark, d):
    return walks.weighted_edges(walks.edge_importance(fx.graph(spark, d)), 100)


@query("saint_rw_nodes", sql("g1 seeds", "SELECT DISTINCT node_id FROM w", *walk_ctes("g1", "seeds", 3)))
def saint_rw_nodes(spark, d):
    return walks.walk(fx.graph(spark, d), fx.seeds(spark, d), 3).select("node_id").distinct()


@query("saint_norm", sql("g1 seeds nodes", f"SELECT node_id, {_round('3.0::DOUBLE / greatest(CAST(coalesce(n, 0) AS DOUBLE), 0.1::DOUBLE) / (SELECT count(*) FROM nodes)', 9)} AS norm FROM nodes LEFT JOIN cnt USING (node_id)",
    *[x for i in range(3) for x in walk_ctes("g1", "seeds", 2, seed=200 + i, name=f"k{i}")],
    "cnt AS (SELECT node_id, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT DISTINCT {i} AS s, node_id FROM k{i}" for i in range(3)) + ") GROUP BY node_id)"))
def saint_norm(spark, d):
    g, s = fx.graph(spark, d), fx.seeds(spark, d)
    samples = None
    for i in range(3):
        one = walks.walk(g, s, 2, seed=200 + i).select(F.lit(i).alias("sample"), "node_id")
        samples = one if samples is None else samples.unionByName(one)
    return walks.node_norm(g.nodes, samples, 3).select("node_id", rounded(F.col("norm"), 9).alias("norm"))


@query("cluster_gcn", sql("nodes", f"SELECT node_id, node_id % 16 AS cluster_id FROM nodes WHERE node_id % 16 IN (SELECT c FROM (SELECT DISTINCT node_id % 16 AS c FROM nodes) ORDER BY {_tape('c', 'c')} LIMIT 4)"))
def cluster_gcn(spark, d):
    return walks.cluster_members(fx.nodes(spark, d), 16, 4)


# ---- aggregation, messages, updates


def _x(spark, d) -> DataFrame:
    return fx.nodes(spark, d).select("node_id", F.col("features").cast("array<double>").alias("h"))


def _agg_sql(how: str) -> str:
    return sql("g1 x", f"SELECT e.dst AS node_id, x.dim, {_round(f'{how}(x.v)')} AS h FROM g1 e JOIN x ON x.node_id = e.src GROUP BY e.dst, x.dim")


def _agg(how: str):
    def run(spark, d):
        return vec.long_form(agg.aggregate(fx.graph(spark, d).edges, _x(spark, d), DIM, how), "h")

    return run


for _how in ("sum", "max", "min"):
    query(f"agg_{_how}", _agg_sql(_how))(_agg(_how))


@query("agg_mean", sql("g1 x", f"SELECT x.node_id, x.dim, {_round('coalesce(m.m, x.v)')} AS h FROM x LEFT JOIN (SELECT e.dst, x.dim, avg(x.v) AS m FROM g1 e JOIN x ON x.node_id = e.src GROUP BY e.dst, x.dim) m ON m.dst = x.node_id AND m.dim = x.dim"))
def agg_mean(spark, d):
    g = fx.graph(spark, d)
    return vec.long_form(agg.mean_or_self(g.edges, _x(spark, d), g.nodes, DIM), "h")


def gcn_sql(edges: str, deg: str, h: str, targets: str, w: float = 1.0) -> str:
    """(node_id, dim, v) of the normalised aggregation; h and targets are relations."""
    return f"""SELECT t.node_id, h.dim, {w}::DOUBLE / (d.d + {w}::DOUBLE) * h.v + coalesce(s.s, 0.0) AS v
FROM (SELECT DISTINCT node_id FROM {targets}) t JOIN {h} h ON h.node_id = t.node_id JOIN {deg} d ON d.node_id = t.node_id
LEFT JOIN (SELECT e.dst, u.dim, sum(u.v / sqrt((a.d + {w}::DOUBLE) * (b.d + {w}::DOUBLE))) AS s FROM {edges} e JOIN {h} u ON u.node_id = e.src JOIN {deg} a ON a.node_id = e.dst JOIN {deg} b ON b.node_id = e.src GROUP BY e.dst, u.dim) s
ON s.dst = t.node_id AND s.dim = h.dim"""


def out_sql(relation: str) -> str:
    return f"SELECT node_id, dim, {_round('v')} AS h FROM {relation}"


@query("agg_gcnnorm", sql("g1 x deg1", out_sql("y"), f"y AS ({gcn_sql('g1', 'deg1', 'x', 'x')})"))
def agg_gcnnorm(spark, d):
    g = fx.graph(spark, d)
    return vec.long_form(agg.gcn_norm(g.edges, _x(spark, d), g.degrees(), g.nodes, DIM), "h")


@query("agg_gcnnorm_improved", sql("g1 x deg1", out_sql("y"), f"y AS ({gcn_sql('g1', 'deg1', 'x', 'x', 2.0)})"))
def agg_gcnnorm_improved(spark, d):
    g = fx.graph(spark, d)
    return vec.long_form(agg.gcn_norm(g.edges, _x(spark, d), g.degrees(), g.nodes, DIM, improved=True), "h")


@query("agg_sampled_gcnnorm", sql("g1 x seeds", out_sql("y"), *sample_ctes("g1", [10, 5]),
    "degs AS (SELECT v.node_id, count(s.src) AS d FROM visited v LEFT JOIN sampled s ON s.dst = v.node_id GROUP BY v.node_id)",
    "targets AS (SELECT node_id FROM visited WHERE hop = 1)", "into1 AS (SELECT src, dst FROM sampled WHERE dst IN (SELECT node_id FROM targets))", f"y AS ({gcn_sql('into1', 'degs', 'x', 'targets')})"))
def agg_sampled_gcnnorm(spark, d):
    nodes, edges = smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [10, 5])
    counted = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("degree"))
    degrees = nodes.join(counted, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    targets = nodes.where("hop = 1").select("node_id")
    into = edges.join(targets.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return vec.long_form(agg.gcn_norm(into, _x(spark, d), degrees, targets, DIM), "h")


@query("agg_gin", sql("g1 x", f"SELECT x.node_id, x.dim, {_round('1.1::DOUBLE * x.v + coalesce(m.m, 0.0)')} AS h FROM x LEFT JOIN (SELECT e.dst, x.dim, sum(x.v) AS m FROM g1 e JOIN x ON x.node_id = e.src GROUP BY e.dst, x.dim) m ON m.dst = x.node_id AND m.dim = x.dim"))
def agg_gin(spark, d):
    g = fx.graph(spark, d)
    return vec.long_form(agg.gin(g.edges, _x(spark, d), g.nodes, DIM, 0.1), "h")


def attention_sql(edges: str, h: str, dim: int) -> str:
    return f"""SELECT e.dst AS node_id, u.dim, sum(w.w * u.v) / min(w.z) AS v FROM {edges} e
JOIN (SELECT src, dst, exp(s - max(s) OVER (PARTITION BY dst)) AS w, sum(exp(s - top)) OVER (PARTITION BY dst) AS z FROM (SELECT src, dst, s, max(s) OVER (PARTITION BY dst) AS top FROM (
  SELECT e.src, e.dst, CASE WHEN a.t + b.s > 0 THEN a.t + b.s ELSE 0.2::DOUBLE * (a.t + b.s) END AS s FROM {edges} e JOIN sc a ON a.node_id = e.dst JOIN sc b ON b.node_id = e.src))) w ON w.src = e.src AND w.dst = e.dst
JOIN {h} u ON u.node_id = e.src GROUP BY e.dst, u.dim"""


@query("agg_attention", sql("g1 x", out_sql("y"), "sc AS (SELECT node_id, sum(v * ((dim % 5) - 2) / 10.0::DOUBLE) AS t, sum(v * ((dim % 7) - 3) / 10.0::DOUBLE) AS s FROM x GROUP BY node_id)", f"y AS ({attention_sql('g1', 'x', 64)})"))
def agg_attention(spark, d):
    g = fx.graph(spark, d)
    return vec.long_form(agg.attention(g.edges, _x(spark, d), [((i % 5) - 2) / 10 for i in range(DIM)], [((i % 7) - 3) / 10 for i in range(DIM)], DIM), "h")


def weight(out: int, inn: int, layer: int = 0) -> list[list[float]]:
    return [[((i * 31 + j * 17 + layer * 7) % 13 - 6) / 10 for j in range(inn)] for i in range(out)]


def bias(out: int, layer: int = 0) -> list[float]:
    return [((i * 5 + layer) % 7 - 3) / 10 for i in range(out)]


def linear_sql(h: str, out: int, layer: int = 0, with_bias: bool = True) -> str:
    w = f"((i * 31 + h.dim * 17 + {layer * 7}) % 13 - 6) / 10.0::DOUBLE"
    b = f" + ((i * 5 + {layer}) % 7 - 3) / 10.0::DOUBLE" if with_bias else ""
    return f"SELECT h.node_id, CAST(i AS BIGINT) AS dim, sum(h.v * {w}){b} AS v FROM {h} h, unnest(range(0, {out})) t(i) GROUP BY h.node_id, i"


@query("msg_linear", sql("x", out_sql("y"), f"y AS ({linear_sql('x', 16)})"))
def msg_linear(spark, d):
    return vec.long_form(_x(spark, d).select("node_id", agg.MESSAGES["linear"](F.col("h"), weight(16, DIM), bias(16)).alias("h")), "h")


@query("msg_degree_norm", sql("g1 x deg1", f"SELECT e.src, e.dst, {_round('sum(x.v / sqrt((a.d + 1.0::DOUBLE) * (b.d + 1.0::DOUBLE)))')} AS total FROM g1 e JOIN x ON x.node_id = e.src JOIN deg1 a ON a.node_id = e.dst JOIN deg1 b ON b.node_id = e.src GROUP BY e.src, e.dst"))
def msg_degree_norm(spark, d):
    g = fx.graph(spark, d)
    rows = agg.with_degrees(g.edges, _x(spark, d), g.degrees())
    return rows.select("src", "dst", vec.let(vec.total(agg.MESSAGES["degree_norm"](F.col("h"), F.col("dv"), F.col("du"))), lambda v: rounded(v)).alias("total"))


@query("msg_scalar", sql("g1 x", f"SELECT e.src, e.dst, {_round('sum(x.v * (1 + (e.src * 7 + e.dst) % 5) / 10.0::DOUBLE)')} AS total FROM g1 e JOIN x ON x.node_id = e.src GROUP BY e.src, e.dst"))
def msg_scalar(spark, d):
    """Neighbours' vectors times an edge weight."""
    w = (1 + (F.col("src") * 7 + F.col("dst")) % 5) / F.lit(10.0)
    rows = fx.graph(spark, d).edges.join(_x(spark, d).withColumnRenamed("node_id", "src"), "src")
    return rows.select("src", "dst", rounded(vec.total(agg.MESSAGES["scalar"](F.col("h"), w))).alias("total"))


@query("msg_edge_linear", sql("g1 x", f"SELECT e.src, e.dst, {_round('sum(x.v * ((x.dim * 17) % 13 - 6) / 10.0::DOUBLE) + ((e.src + e.dst) % 3) * ((64 * 17) % 13 - 6) / 10.0::DOUBLE - 0.3::DOUBLE')} AS h0 FROM g1 e JOIN x ON x.node_id = e.src GROUP BY e.src, e.dst"))
def msg_edge_linear(spark, d):
    """W [h_u | e] + b with one edge feature."""
    e = F.array(((F.col("src") + F.col("dst")) % 3).cast("double"))
    rows = fx.graph(spark, d).edges.join(_x(spark, d).withColumnRenamed("node_id", "src"), "src")
    return rows.select("src", "dst", rounded(agg.MESSAGES["edge_linear"](F.col("h"), e, weight(1, DIM + 1), bias(1))[0]).alias("h0"))


@query("msg_identity", sql("g1 x", f"SELECT e.src, e.dst, {_round('sum(x.v)')} AS total FROM g1 e JOIN x ON x.node_id = e.src GROUP BY e.src, e.dst"))
def msg_identity(spark, d):
    rows = fx.graph(spark, d).edges.join(_x(spark, d).withColumnRenamed("node_id", "src"), "src")
    return rows.select("src", "dst", rounded(vec.total(agg.MESSAGES["identity"](F.col("h")))).alias("total"))


@query("upd_gin_mlp", sql("g1 x", out_sql("y"), "s AS (SELECT x.node_id, x.dim, 1.1::DOUBLE * x.v + coalesce(m.m, 0.0) AS v FROM x LEFT JOIN (SELECT e.dst, x.dim, sum(x.v) AS m FROM g1 e JOIN x ON x.node_id = e.src GROUP BY e.dst, x.dim) m ON m.dst = x.node_id AND m.dim = x.dim)",
    f"l1 AS ({linear_sql('s', 8)})", "r1 AS (SELECT node_id, dim, CASE WHEN v < 0 THEN 0.0 ELSE v END AS v FROM l1)", f"y AS ({linear_sql('r1', 4, 1)})"))
def upd_gin_mlp(spark, d):
    """Two dense layers over (1 + eps) h + sum, as one pass of matrix products."""
    g = fx.graph(spark, d)
    s = agg.gin(g.edges, _x(spark, d), g.nodes, DIM, 0.1)
    layers = [Layer("linear", weight="a", bias="p"), Layer("relu"), Layer("linear", weight="b", bias="q")]
    return vec.long_form(dense(s, layers, {"a": weight(8, DIM), "p": bias(8), "b": weight(4, 8, 1), "q": bias(4, 1)}), "h")


@query("degree_stored", sql("g1 deg1", "SELECT node_id, CASE WHEN node_id % 2 = 0 THEN node_id % 11 ELSE d END AS degree FROM deg1"))
def degree_stored(spark, d):
    """The stored degree where a node has one, else the counted one."""
    g = fx.graph(spark, d)
    stored = F.when(F.col("node_id") % 2 == 0, (F.col("node_id") % 11).cast("string"))
    return PropertyGraph(g.nodes.withColumn("in_degree", stored), g.edges).resolved_degrees("in_degree")


@query("degree_labelled", sql("g1 nodes", "SELECT n.node_id, count(e.src) AS degree FROM nodes n LEFT JOIN (SELECT g1.* FROM g1 JOIN nodes a ON a.node_id = src WHERE a.target % 2 = 0) e ON e.dst = n.node_id GROUP BY n.node_id"))
def degree_labelled(spark, d):
    """In-degrees over neighbours of one label."""
    g = fx.graph(spark, d)
    labelled = g.nodes.withColumn("label", F.when(F.col("target") % 2 == 0, "even").otherwise("odd"))
    return PropertyGraph(labelled, g.edges).degrees(neighbor_label="even")


@query("upd_relu", sql("x", f"SELECT node_id, dim, {_round('CASE WHEN v < 0 THEN 0.0 ELSE v END')} AS h FROM x"))
def upd_relu(spark, d):
    return vec.long_form(_x(spark, d).select("node_id", agg.UPDATES["relu"](F.col("h")).alias("h")), "h")


@query("upd_tanh", sql("x", f"SELECT node_id, dim, {_round('(exp(v) - exp(-v)) / (exp(v) + exp(-v))')} AS h FROM x"))
def upd_tanh(spark, d):
    return vec.long_form(_x(spark, d).select("node_id", agg.UPDATES["tanh"](F.col("h")).alias("h")), "h")


@query("upd_elu", sql("x", f"SELECT node_id, dim, {_round('CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END')} AS h FROM x"))
def upd_elu(spark, d):
    return vec.long_form(_x(spark, d).select("node_id", agg.UPDATES["elu"](F.col("h")).alias("h")), "h")


@query("upd_softmax", sql("x", f"SELECT node_id, dim, {_round('exp(v) / sum(exp(v)) OVER (PARTITION BY node_id)')} AS h FROM x"))
def upd_softmax(spark, d):
    return vec.long_form(_x(spark, d).select("node_id", agg.softmax(F.col("h")).alias("h")), "h")


_MEAN2 = "m AS (SELECT x.node_id, x.dim, coalesce(a.v, x.v) AS v FROM x LEFT JOIN (SELECT e.dst, x.dim, avg(x.v) AS v FROM g1 e JOIN x ON x.node_id = e.src GROUP BY e.dst, x.dim) a ON a.dst = x.node_id AND a.dim = x.dim)"


def _own_and_mean(spark, d):
    g = fx.graph(spark, d)
    m = agg.mean_or_self(g.edges, _x(spark, d), g.nodes, DIM).withColumnRenamed("h", "m")
    return _x(spark, d).join(m, "node_id")


@query("upd_sage", sql("g1 x", out_sql("y"), _MEAN2, "cat AS (SELECT * FROM x UNION ALL SELECT node_id, dim + 64, v FROM m)", f"y AS ({linear_sql('cat', 8)})"))
def upd_sage(spark, d):
    return vec.long_form(_own_and_mean(spark, d).select("node_id", agg.UPDATES["concat_linear"](F.col("h"), F.col("m"), weight(8, 2 * DIM), bias(8)).alias("h")), "h")


@query("upd_residual", sql("g1 x", f"SELECT node_id, dim, {_round('x.v + m.v')} AS h FROM x JOIN m USING (node_id, dim)", _MEAN2))
def upd_residual(spark, d):
    return vec.long_form(_own_and_mean(spark, d).select("node_id", agg.UPDATES["residual"](F.col("h"), F.col("m")).alias("h")), "h")


@query("upd_gated", sql("g1 x", f"SELECT node_id, dim, {_round('1 / (1 + exp(-x.v)) * tanh(m.v) + (1 - 1 / (1 + exp(-x.v))) * x.v')} AS h FROM x JOIN m USING (node_id, dim)", _MEAN2))
def upd_gated(spark, d):
    return vec.long_form(_own_and_mean(spark, d).select("node_id", agg.UPDATES["gated"](F.col("h"), F.col("m"), F.col("h")).alias("h")), "h")


# ---- inference


def gcn_spec() -> ModelSpec:
    layers = compile_layers([("conv", "a", True), ("conv", "b", True), ("linear", "c")])
    return ModelSpec(2, [10, 5], layers, {"a.weight": weight(8, DIM), "a.bias": bias(8), "b.weight": weight(8, 8, 1), "b.bias": bias(8, 1), "c.weight": weight(10, 8, 2), "c.bias": bias(10, 2)})


def relu_sql(h: str) -> str:
    return f"SELECT node_id, dim, CASE WHEN v < 0 THEN 0.0 ELSE v END AS v FROM {h}"


def gcn_ctes(edges1: str, edges2: str, deg: str, start: str, t1: str, t2: str) -> list[str]:
    return [f"a1 AS ({gcn_sql(edges1, deg, start, t1)})", f"l1 AS ({linear_sql('a1', 8)})", f"r1 AS ({relu_sql('l1')})", f"a2 AS ({gcn_sql(edges2, deg, 'r1', t2)})", f"l2 AS ({linear_sql('a2', 8, 1)})", f"r2 AS ({relu_sql('l2')})", f"y AS ({linear_sql('r2', 10, 2)})"]


_SAMPLED = [*sample_ctes("g1", [10, 5]), "t1 AS (SELECT node_id FROM visited WHERE hop <= 1)", "t2 AS (SELECT node_id FROM visited WHERE hop <= 0)", "e1 AS (SELECT src, dst FROM sampled WHERE dst IN (SELECT node_id FROM t1))", "e2 AS (SELECT src, dst FROM sampled WHERE dst IN (SELECT node_id FROM t2))", *gcn_ctes("e1", "e2", "deg1", "x", "t1", "t2")]


@query("gcn_infer_2hop", sql("g1 x deg1 seeds", out_sql("y"), *_SAMPLED))
def gcn_infer_2hop(spark, d):
    return vec.long_form(infer(fx.graph(spark, d), fx.seeds(spark, d), gcn_spec()), "h")


@query("gcn_infer_full", sql("g1 x deg1", out_sql("y"), *gcn_ctes("g1", "g1", "deg1", "x", "x", "x")))
def gcn_infer_full(spark, d):
    return vec.long_form(infer(fx.graph(spark, d), None, gcn_spec()), "h")


@query("gcn_infer_naive", sql("g1 x deg1", out_sql("y"), *gcn_ctes("g1", "g1", "deg1", "x", "x", "x")))
def gcn_infer_naive(spark, d):
    """Without the planner's rewrites."""
    return vec.long_form(infer(fx.graph(spark, d), None, gcn_spec(), rewrite=False), "h")


@query("gcn_infer_preagg", sql("g1 x seeds", out_sql("y"), *sample_ctes("g1", [10, 5]), "degs AS (SELECT v.node_id, count(s.src) AS d FROM visited v LEFT JOIN sampled s ON s.dst = v.node_id GROUP BY v.node_id)",
    "t1 AS (SELECT node_id FROM visited WHERE hop <= 1)", "t2 AS (SELECT node_id FROM visited WHERE hop <= 0)", "e1 AS (SELECT src, dst FROM sampled WHERE dst IN (SELECT node_id FROM t1))", "e2 AS (SELECT src, dst FROM sampled WHERE dst IN (SELECT node_id FROM t2))", *gcn_ctes("e1", "e2", "degs", "x", "t1", "t2")))
def gcn_infer_preagg(spark, d):
    """Degrees of the sampled edges."""
    return vec.long_form(infer(fx.graph(spark, d), fx.seeds(spark, d), gcn_spec(), degree="sampled"), "h")


@query("mean_infer", sql("g1 x", out_sql("y"), _MEAN2, f"l1 AS ({linear_sql('m', 10)})", f"y AS ({relu_sql('l1')})"))
def mean_infer(spark, d):
    spec = ModelSpec(1, [-1], [Layer("aggregate", "mean"), Layer("linear", weight="w", bias="b"), Layer("relu")], {"w": weight(10, DIM), "b": bias(10)})
    return vec.long_form(infer(fx.graph(spark, d), None, spec), "h")


@query("gat_gcn_infer", sql("g1 x deg1", out_sql("y"), f"p AS ({linear_sql('x', 8)})", "sc AS (SELECT node_id, sum(v * ((dim % 5) - 2) / 10.0::DOUBLE) AS t, sum(v * ((dim % 7) - 3) / 10.0::DOUBLE) AS s FROM p GROUP BY node_id)",
    f"ga AS ({attention_sql('g1', 'p', 8)})", "el AS (SELECT node_id, dim, CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END AS v FROM ga)", f"gc AS ({gcn_sql('g1', 'deg1', 'el', 'el')})", f"y AS ({linear_sql('gc', 4, 1)})"))
def gat_gcn_infer(spark, d):
    """Attention, ELU, normalised aggregation and a linear layer."""
    layers = compile_layers([("gat", "a"), ("elu",), ("conv", "b")])
    heads = [[((i % 5) - 2) / 10 for i in range(8)], [((i % 7) - 3) / 10 for i in range(8)]]
    spec = ModelSpec(2, [-1, -1], layers, {"a.weight": weight(8, DIM), "a.bias": bias(8), "a.attention": heads, "b.weight": weight(4, 8, 1), "b.bias": bias(4, 1)})
    return vec.long_form(infer(fx.graph(spark, d), None, spec), "h")


_GIN = ["s AS (SELECT x.node_id, x.dim, 1.1::DOUBLE * x.v + coalesce(m.m, 0.0) AS v FROM x LEFT JOIN (SELECT e.dst, x.dim, sum(x.v) AS m FROM g1 e JOIN x ON x.node_id = e.src GROUP BY e.dst, x.dim) m ON m.dst = x.node_id AND m.dim = x.dim)",
    f"l1 AS ({linear_sql('s', 8)})", f"r1 AS ({relu_sql('l1')})", f"l2 AS ({linear_sql('r1', 4, 1)})", "y AS (SELECT node_id, dim, exp(v - top) / sum(exp(v - top)) OVER (PARTITION BY node_id) AS v FROM (SELECT *, max(v) OVER (PARTITION BY node_id) AS top FROM l2))"]


@query("gin_infer", sql("g1 x", out_sql("y"), *_GIN))
def gin_infer(spark, d):
    """A GIN layer with its two dense layers, and a softmax."""
    spec = ModelSpec(1, [-1], compile_layers([("gin", "a", 0.1), ("softmax",)]), {"a.0.weight": weight(8, DIM), "a.0.bias": bias(8), "a.1.weight": weight(4, 8, 1), "a.1.bias": bias(4, 1)})
    return vec.long_form(infer(fx.graph(spark, d), None, spec), "h")


_PRED = "pred AS (SELECT node_id, arg_min(dim, (-round(v, 6), dim)) AS predicted FROM y GROUP BY node_id)"


@query("argmax_pred", sql("g1 x deg1", "SELECT node_id, predicted FROM pred", *gcn_ctes("g1", "g1", "deg1", "x", "x", "x"), _PRED))
def argmax_pred(spark, d):
    return predict(infer(fx.graph(spark, d), None, gcn_spec()))


@query("pred_accuracy", sql("g1 x deg1 nodes", "SELECT split, avg(CASE WHEN predicted = target THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy, count(*) AS n FROM pred JOIN nodes USING (node_id) GROUP BY split", *gcn_ctes("g1", "g1", "deg1", "x", "x", "x"), _PRED))
def pred_accuracy(spark, d):
    p = predict(infer(fx.graph(spark, d), None, gcn_spec())).join(fx.nodes(spark, d), "node_id")
    return p.groupBy("split").agg(F.avg(F.when(F.col("predicted") == F.col("target"), 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n"))


@query("pred_agreement", sql("g1 x deg1 seeds", "SELECT avg(CASE WHEN a.predicted = b.predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS agreement, count(*) AS n FROM pa a JOIN pb b USING (node_id)", *_SAMPLED, _PRED.replace("pred AS", "pa AS"),
    *[x.replace("a1", "fa1").replace("l1", "fl1").replace("r1", "fr1").replace("a2", "fa2").replace("l2", "fl2").replace("r2", "fr2").replace("y AS", "fy AS") for x in gcn_ctes("g1", "g1", "deg1", "x", "x", "x")], _PRED.replace("pred AS", "pb AS").replace("FROM y", "FROM fy")))
def pred_agreement(spark, d):
    g = fx.graph(spark, d)
    a = predict(infer(g, fx.seeds(spark, d), gcn_spec()))
    b = predict(infer(g, None, gcn_spec())).withColumnRenamed("predicted", "other")
    return a.join(b, "node_id").agg(F.avg(F.when(F.col("predicted") == F.col("other"), 1.0).otherwise(0.0)).alias("agreement"), F.count("*").alias("n"))


def _losses(spark, d) -> DataFrame:
    h = infer(fx.graph(spark, d), None, gcn_spec()).join(fx.nodes(spark, d).select("node_id", "target", "split"), "node_id")
    top = F.array_max("h")
    z = F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return h.select("node_id", "split", (F.log(z) + top - F.element_at("h", F.col("target").cast("int") + 1)).alias("loss"))


_LOSS = "loss AS (SELECT y.node_id, n.split, ln(sum(exp(y.v - t.top))) + min(t.top) - min(CASE WHEN y.dim = n.target THEN y.v END) AS loss FROM y JOIN nodes n USING (node_id) JOIN (SELECT node_id, max(v) AS top FROM y GROUP BY node_id) t USING (node_id) GROUP BY y.node_id, n.split)"


@query("cross_entropy", sql("g1 x deg1 nodes", f"SELECT split, {_round('avg(loss)')} AS loss FROM loss GROUP BY split", *gcn_ctes("g1", "g1", "deg1", "x", "x", "x"), _LOSS))
def cross_entropy(spark, d):
    return _losses(spark, d).groupBy("split").agg(rounded(F.avg("loss")).alias("loss"))


@query("saint_weighted_loss", sql("g1 x deg1 nodes", f"SELECT {_round('sum(loss * w) / sum(w)')} AS loss FROM (SELECT loss, 1.0::DOUBLE / (1 + node_id % 7) AS w FROM loss WHERE split = 'train')", *gcn_ctes("g1", "g1", "deg1", "x", "x", "x"), _LOSS))
def saint_weighted_loss(spark, d):
    rows = _losses(spark, d).where("split = 'train'").withColumn("w", F.lit(1.0) / (1 + F.col("node_id") % 7))
    return rows.agg(rounded(F.sum(F.col("loss") * F.col("w")) / F.sum("w")).alias("loss"))


# ---- hot sets, caches, partitions


def pagerank_ctes(rounds: int) -> list[str]:
    out = ["dg AS (SELECT src AS node_id, count(*) AS d FROM und1 GROUP BY src)", "p0 AS (SELECT vec_id AS node_id, 1.0::DOUBLE AS r FROM embeddings)"]
    for i in range(1, rounds + 1):
        out.append(f"p{i} AS MATERIALIZED (SELECT n.node_id, (1 - 0.85::DOUBLE) + 0.85::DOUBLE * coalesce(s.s, 0.0) AS r FROM p0 n LEFT JOIN (SELECT e.dst, sum(p.r / g.d) AS s FROM und1 e JOIN p{i - 1} p ON p.node_id = e.src JOIN dg g ON g.node_id = e.src GROUP BY e.dst) s ON s.dst = n.node_id)")
    return out


@query("pagerank_topk", sql("g1 und1", f"SELECT node_id, {_round('r')} AS rank FROM p10 ORDER BY round(r, 6) DESC, node_id LIMIT 50", *pagerank_ctes(10)))
def pagerank_topk(spark, d):
    r = feat.pagerank(fx.graph(spark, d), 10)
    return r.select("node_id", rounded(F.col("rank")).alias("rank")).orderBy(F.col("rank").desc(), "node_id").limit(50)


@query("hotset_hits", sql("g1", "SELECT count(h.node_id) AS hits, count(*) - count(h.node_id) AS misses, count(h.node_id) / CAST(count(*) AS DOUBLE) AS hit_rate FROM g1 e LEFT JOIN (SELECT src AS node_id FROM g1 GROUP BY src ORDER BY count(*) DESC, src LIMIT 100) h ON h.node_id = e.src"))
def hotset_hits(spark, d):
    g = fx.graph(spark, d)
    return feat.hit_summary(g.edges.select(F.col("src").alias("node_id")), feat.top_out_degree(g, 100).select("node_id"))


@query("tiered_lookup", sql("g1 nodes", """SELECT r.pos, r.node_id, CASE WHEN h.node_id IS NOT NULL THEN 0 WHEN r.node_id IN (SELECT node_id FROM nodes WHERE split = 'val') THEN 1 ELSE -1 END AS tier FROM (SELECT o_orderkey AS pos, o_custkey AS node_id FROM orders) r
LEFT JOIN (SELECT src AS node_id FROM g1 GROUP BY src ORDER BY count(*) DESC, src LIMIT 100) h ON h.node_id = r.node_id"""))
def tiered_lookup(spark, d):
    hot = feat.top_out_degree(fx.graph(spark, d), 100)
    warm = fx.nodes(spark, d).where("split = 'val'").select("node_id")
    return feat.tiered(_requests(spark, d), hot, warm).select("pos", "node_id", F.coalesce("tier", F.lit(-1)).alias("tier"))


def _lru_sql(requests: str) -> str:
    """lru_hits(cache_id, pos, hit): an LRU cache of 200 entries hits where fewer than 200 others were used since the last use."""
    return f"""req AS ({requests}), turns AS (SELECT *, lag(rn) OVER (PARTITION BY cache_id, node_id ORDER BY rn) AS prev FROM (SELECT *, row_number() OVER (PARTITION BY cache_id ORDER BY pos, node_id) AS rn FROM req)),
between_ AS (SELECT a.cache_id, a.rn, count(DISTINCT b.node_id) AS others FROM turns a JOIN turns b ON b.cache_id = a.cache_id AND b.rn > a.prev AND b.rn < a.rn GROUP BY a.cache_id, a.rn),
lru_hits AS (SELECT t.cache_id, t.pos, t.prev IS NOT NULL AND coalesce(o.others, 0) < 200 AS hit FROM turns t LEFT JOIN between_ o ON o.cache_id = t.cache_id AND o.rn = t.rn)"""


_WORKERS = "SELECT l_suppkey % 8 AS cache_id, l_orderkey * 8 + l_linenumber AS pos, l_partkey % 400 AS node_id FROM lineitem"


def _worker_requests(spark, d):
    line = fx.table(spark, d, "lineitem")
    return line.select((F.col("l_suppkey") % 8).alias("cache_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") % 400).alias("node_id"))


@query("lru_sim", f"WITH {_lru_sql(_WORKERS)} SELECT cache_id, count(*) AS requests, count(*) FILTER (hit) AS hits FROM lru_hits GROUP BY cache_id")
def lru_sim(spark, d):
    """A cache of 200 entries for each of 8 workers, replayed over their requests."""
    return feat.lru(_worker_requests(spark, d), 200).groupBy("cache_id").agg(F.count("*").alias("requests"), F.count(F.when(F.col("hit"), 1)).alias("hits"))


@query("two_level_hits", sql("g1", "SELECT cache_id, CAST(sum(h) AS BIGINT) AS hot, CAST(sum(b) AS BIGINT) AS behind, CAST(sum(m) AS BIGINT) AS missed FROM (SELECT cache_id, 1 AS h, 0 AS b, 0 AS m FROM allreq WHERE node_id IN (SELECT node_id FROM hs) UNION ALL SELECT cache_id, 0, hit::INT, 1 - hit::INT FROM lru_hits) GROUP BY cache_id",
    "hs AS (SELECT src AS node_id FROM g1 GROUP BY src ORDER BY count(*) DESC, src LIMIT 100)", f"allreq AS ({_WORKERS})", _lru_sql("SELECT * FROM allreq WHERE node_id NOT IN (SELECT node_id FROM hs)")))
def two_level_hits(spark, d):
    """A fixed hot set of 100 nodes before an LRU cache of 200 entries for each worker."""
    rows = caches.two_level(_worker_requests(spark, d), feat.top_out_degree(fx.graph(spark, d), 100), 200)
    return rows.groupBy("cache_id").agg(*[F.count(F.when(F.coalesce("tier", F.lit(2)) == i, 1)).alias(n) for i, n in enumerate(("hot", "behind", "missed"))])


@query("edge_cut", sql("g1", "SELECT c.cut, c.edges, s.balance FROM (SELECT count(CASE WHEN a % 4 <> b % 4 THEN 1 END) AS cut, count(*) AS edges FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g1)) c, (SELECT max(n) / avg(n) AS balance FROM (SELECT vec_id % 4 AS p, count(*) AS n FROM embeddings GROUP BY 1)) s"))
def edge_cut(spark, d):
    g = fx.graph(spark, d)
    return feat.edge_cut(g.edges, feat.partition_ids(g.nodes, 4))


def propagate_ctes(rounds: int) -> list[str]:
    out = ["q0 AS (SELECT vec_id AS node_id, vec_id % 4 AS part FROM embeddings)"]
    for i in range(1, rounds + 1):
        out.append(f"q{i} AS MATERIALIZED (SELECT n.node_id, coalesce(w.part, n.part) AS part FROM q{i - 1} n LEFT JOIN (SELECT dst, part FROM (SELECT dst, part, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, part) AS rn FROM und1 JOIN q{i - 1} q ON q.node_id = src GROUP BY dst, part) WHERE rn = 1) w ON w.dst = n.node_id)")
    return out


@query("partition_propagation", sql("g1 und1", "SELECT node_id, part FROM q3", *propagate_ctes(3)))
def partition_propagation(spark, d):
    return feat.propagate_labels(fx.graph(spark, d), 4, 3)


# ---- measurements


_PAIRED = "numbered AS (SELECT event, time, row_number() OVER (PARTITION BY event ORDER BY time, event_id) AS rn FROM log)"
_DURATIONS = "pairs AS (" + " UNION ALL ".join(f"SELECT '{a}_{b}' AS pair, s.rn, greatest(e.time - s.time, 0.0) AS duration FROM numbered s JOIN numbered e ON s.rn = e.rn WHERE s.event = '{a}' AND e.event = '{b}'" for a, b in ev.PAIRS) + ")"


@query("event_pairs", sql("log", f"SELECT pair, rn, {_round('duration')} AS duration FROM pairs", _PAIRED, _DURATIONS))
def event_pairs(spark, d):
    return ev.pair_durations(fx.log(spark, d)).select("pair", "rn", rounded(F.col("duration")).alias("duration"))


@query("event_stats", sql("log", "SELECT pair, count(*) AS n, " + ", ".join(f"{_round(x, 4)} AS {n}" for x, n in (("sum(duration)", "total"), ("avg(duration)", "mean"), ("quantile_cont(duration, 0.5)", "p50"), ("quantile_cont(duration, 0.9)", "p90"), ("quantile_cont(duration, 0.99)", "p99"), ("min(duration)", "least"), ("max(duration)", "largest"))) + " FROM pairs GROUP BY pair", _PAIRED, _DURATIONS))
def event_stats(spark, d):
    out = ev.stats(ev.pair_durations(fx.log(spark, d)), ["pair"], "duration")
    return out.select("pair", "n", *[rounded(F.col(c), 4).alias(c) for c in ("total", "mean", "p50", "p90", "p99", "least", "largest")])


@query("best_value", sql("log", f"SELECT event, {_round('min(time)')} AS first_time, {_round('max(time)')} AS last_time, arg_max(value, (time, event_id)) AS last_value, max(value) AS best_value, {_round('arg_min(time, (-value, time))')} AS best_time FROM log GROUP BY event"))
def best_value(spark, d):
    out = ev.best_values(fx.log(spark, d), ["event"])
    return out.select("event", rounded(F.col("first_time")).alias("first_time"), rounded(F.col("last_time")).alias("last_time"), "last_value", "best_value", rounded(F.col("best_time")).alias("best_time"))


@query("best_value_min", sql("log", f"SELECT event, {_round('min(time)')} AS first_time, {_round('max(time)')} AS last_time, arg_max(value, (time, event_id)) AS last_value, min(value) AS best_value, {_round('arg_min(time, (value, time))')} AS best_time FROM log GROUP BY event"))
def best_value_min(spark, d):
    out = ev.best_values(fx.log(spark, d), ["event"], largest=False)
    return out.select("event", rounded(F.col("first_time")).alias("first_time"), rounded(F.col("last_time")).alias("last_time"), "last_value", "best_value", rounded(F.col("best_time")).alias("best_time"))


@query("throughput", sql("log", f"SELECT event, count(*) AS n, {_round('max(time) - min(time)')} AS runtime, {_round('count(*) * 3.0::DOUBLE / (max(time) - min(time))', 9)} AS throughput FROM log GROUP BY event"))
def throughput(spark, d):
    return ev.throughput(fx.log(spark, d), ["event"], 3).select("event", "n", rounded(F.col("runtime")).alias("runtime"), rounded(F.col("throughput"), 9).alias("throughput"))


@query("hit_rate", sql("log", f"SELECT {_round('r.a / CAST(r.a + r.b AS DOUBLE)')} AS row_rate, {_round('r.x / (r.x + r.y)')} AS value_rate FROM (SELECT count(*) FILTER (event = 'purchase') AS a, count(*) FILTER (event = 'error') AS b, sum(value) FILTER (event = 'purchase') AS x, sum(value) FILTER (event = 'error') AS y FROM log) r"))
def hit_rate(spark, d):
    out = ev.hit_rates(fx.log(spark, d), "purchase", "error")
    return out.select(rounded(F.col("row_rate")).alias("row_rate"), rounded(F.col("value_rate")).alias("value_rate"))


@query("seed_ratio", sql("log", f"SELECT {_round('avg(a.value / b.value)')} AS ratio FROM n a JOIN n b ON a.rn = b.rn AND a.event = 'view' AND b.event = 'click' WHERE b.value <> 0", "n AS (SELECT event, value, row_number() OVER (PARTITION BY event ORDER BY time, event_id) AS rn FROM log)"))
def seed_ratio(spark, d):
    return ev.position_ratio(fx.log(spark, d), "view", "click").select(rounded(F.col("ratio")).alias("ratio"))


@query("ci95", sql("log", f"SELECT user_id, event, count(value) AS n, {_round('avg(value)')} AS mean, {_round('coalesce(stddev_samp(value), 0.0)')} AS std, {_round('1.96::DOUBLE * coalesce(stddev_samp(value), 0.0) / sqrt(count(value))')} AS ci95 FROM log GROUP BY user_id, event"))
def ci95(spark, d):
    out = ev.confidence(fx.log(spark, d), ["user_id", "event"], "value")
    return out.select("user_id", "event", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "ci95")])


def _spans(spark, d) -> DataFrame:
    log = fx.log(spark, d)
    rows = ev.numbered(log, ["view", "click"], ["user_id"])
    a = rows.where("event = 'view'").select("user_id", "rn", F.col("time").alias("t0"))
    b = rows.where("event = 'click'").select("user_id", "rn", F.col("time").alias("t1"))
    return a.join(b, ["user_id", "rn"]).where("t1 > t0").select("user_id", F.col("rn").cast("long").alias("span"), "t0", "t1")


@query("phase_cpu", sql("log", f"SELECT user_id, span, count(*) AS n, {_round('avg(CASE WHEN dt > 0 THEN dv / dt END)')} AS rate FROM rates GROUP BY user_id, span",
    "un AS (SELECT user_id, event, time, row_number() OVER (PARTITION BY user_id, event ORDER BY time, event_id) AS rn FROM log)", "spans AS (SELECT a.user_id, a.rn AS span, a.time AS t0, b.time AS t1 FROM un a JOIN un b USING (user_id, rn) WHERE a.event = 'view' AND b.event = 'click' AND b.time > a.time)",
    "rates AS (SELECT s.user_id, s.span, l.value - lag(l.value) OVER w AS dv, l.time - lag(l.time) OVER w AS dt FROM spans s JOIN log l ON l.user_id = s.user_id AND l.time BETWEEN s.t0 AND s.t1 WINDOW w AS (PARTITION BY s.user_id, s.span ORDER BY l.time, l.event_id))"))
def phase_cpu(spark, d):
    out = ev.phase_rates(fx.log(spark, d), _spans(spark, d), "user_id", 86_400.0)
    return out.select("user_id", "span", "n", rounded(F.col("rate")).alias("rate"))


@query("boxcar", sql("log", f"SELECT event_id, {_round('avg(value) OVER (PARTITION BY event ORDER BY time RANGE BETWEEN 1800.0 PRECEDING AND 1800.0 FOLLOWING)')} AS smooth FROM log"))
def boxcar(spark, d):
    return ev.boxcar(fx.log(spark, d), ["event"], 3600.0).select("event_id", rounded(F.col("smooth")).alias("smooth"))


@query("interp_grid", sql("log", f"SELECT event, i, {_round('t', 4)} AS t, {_round('CASE WHEN at > bt THEN bv + (av - bv) * (t - bt) / (at - bt) ELSE bv END', 4)} AS value FROM (SELECT g.event, g.i, g.t, b.time AS bt, b.value AS bv, a.time AS at, a.value AS av FROM grid g ASOF JOIN s b ON b.event = g.event AND b.time <= g.t ASOF JOIN s a ON a.event = g.event AND a.time >= g.t)".replace(" at,", " att,").replace("at > bt", "att > bt").replace("(at - bt)", "(att - bt)"),
    "s AS (SELECT event, time, avg(value) AS value FROM log GROUP BY event, time)", "grid AS (SELECT event, CAST(i AS BIGINT) AS i, t0 + (t1 - t0) * i / 299.0::DOUBLE AS t FROM (SELECT event, min(time) AS t0, max(time) AS t1 FROM log GROUP BY event), unnest(range(0, 300)) u(i))"))
def interp_grid(spark, d):
    out = ev.on_grid(fx.log(spark, d), "event", 300)
    return out.select("event", "i", rounded(F.col("t"), 4).alias("t"), rounded(F.col("value"), 4).alias("value"))


@query("topk_profile", f"SELECT l_suppkey AS operator, {_round('avg(l_extendedprice)')} AS mean, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY avg(l_extendedprice) DESC, 1 LIMIT 5")
def topk_profile(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("operator"), "l_extendedprice")
    return ev.top_operators(rows, "operator", "l_extendedprice").select("operator", rounded(F.col("mean")).alias("mean"), "n")


@query("profile_flatten", "SELECT o_orderkey AS query, '0' AS path, 'order' AS operator, o_totalprice AS time, CAST(o_custkey AS BIGINT) AS hits FROM orders UNION ALL SELECT l_orderkey, '0.' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) - 1), 'line', l_extendedprice, l_partkey FROM lineitem")
def profile_flatten(spark, d):
    line = fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_partkey"))).alias("c"))
    rows = fx.table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    leaf = F.transform(F.coalesce("c", F.array().cast("array<struct<l_linenumber:int,l_extendedprice:double,l_partkey:bigint>>")), lambda x: F.struct(F.lit("line").alias("operator"), x["l_extendedprice"].alias("time"), x["l_partkey"].cast("long").alias("hits")))
    return ev.flatten_profile(rows.select(F.col("o_orderkey").alias("query"), F.struct(F.lit("order").alias("operator"), F.col("o_totalprice").alias("time"), F.col("o_custkey").cast("long").alias("hits"), leaf.alias("children")).alias("plan")))


@query("speedup_ratio", f"SELECT a.l_returnflag, a.l_linestatus AS variant, {_round('a.m / b.m')} AS ratio FROM (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL) a JOIN (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL) b ON a.l_returnflag = b.l_returnflag AND b.l_linestatus = 'F' WHERE a.l_linestatus <> 'F'")
def speedup_ratio(spark, d):
    rows = fx.table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_linestatus").alias("variant")).agg(F.avg("l_extendedprice").alias("m"))
    return ev.ratio_to_baseline(rows, ["l_returnflag"], "variant", "F", "m").select("l_returnflag", "variant", rounded(F.col("ratio")).alias("ratio"))


@query("latency_pivot", f"SELECT user_id, {', '.join(_round(f'sum(value) FILTER (event = {chr(39)}{e}{chr(39)}) / count(*) FILTER (event = {chr(39)}{e}{chr(39)}) * 1000') + f' AS {e}' for e in ('click', 'view'))} FROM log GROUP BY user_id".join(["WITH " + fx.CTES["log"] + " ", ""]))
def latency_pivot(spark, d):
    rows = fx.log(spark, d).groupBy("user_id").pivot("event", ["click", "view"]).agg((F.sum("value") / F.count("value") * 1000).alias("ms"))
    return rows.select("user_id", rounded(F.col("click")).alias("click"), rounded(F.col("view")).alias("view"))


@query("latency_other", f"SELECT l_orderkey, l_linenumber, {_round('greatest(l_extendedprice - l_quantity * 500 - l_tax * 1000, 0.0)')} AS other FROM lineitem")
def latency_other(spark, d):
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_quantity") * 500).alias("a"), (F.col("l_tax") * 1000).alias("b"))
    return ev.latency_parts(rows, "l_extendedprice", ["a", "b"]).select("l_orderkey", "l_linenumber", rounded(F.col("other")).alias("other"))


@query("warm_runs", sql("log", f"SELECT event, count(*) AS n, {_round('avg(value)')} AS mean, {_round('stddev_pop(value)')} AS std FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY event_id) AS rn FROM log) WHERE rn > 10 GROUP BY event"))
def warm_runs(spark, d):
    out = ev.confidence(ev.after_warmup(fx.log(spark, d), ["event"], "event_id", 10), ["event"], "value", population=True)
    return out.select("event", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))


@query("series_trimmed", sql("log", "SELECT event, rn, value FROM n WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM log GROUP BY event))", "n AS (SELECT event, value, row_number() OVER (PARTITION BY event ORDER BY time, event_id) AS rn FROM log)"))
def series_trimmed(spark, d):
    rows = ev.numbered(fx.log(spark, d), ["view", "click", "purchase", "signup", "error"]).select("event", F.col("rn").cast("long").alias("rn"), "value")
    return ev.trimmed_series(rows, "event", "rn")


@query("early_stop", sql("log", """SELECT user_id, max(stop) AS stopped_at, arg_max(best, i) AS best FROM run WHERE stop IS NULL OR i = stop GROUP BY user_id""",
    "ord AS MATERIALIZED (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM log)",
    "steps(user_id, i, best, bad, stop) AS (SELECT user_id, i, value, 0, CAST(NULL AS BIGINT) FROM ord WHERE i = 1 UNION ALL SELECT s.user_id, o.i, CASE WHEN o.value > s.best + 0.5 THEN o.value ELSE s.best END, CASE WHEN o.value > s.best + 0.5 THEN 0 ELSE s.bad + 1 END, CASE WHEN o.value <= s.best + 0.5 AND s.bad + 1 >= 5 THEN o.i END FROM steps s JOIN ord o ON o.user_id = s.user_id AND o.i = s.i + 1 WHERE s.stop IS NULL)",
    "run AS (SELECT * FROM steps)").replace("WITH ", "WITH RECURSIVE ", 1))
def early_stop(spark, d):
    return ev.early_stop(fx.log(spark, d), "user_id", "event_id", "value", 5, 0.5)


# ---- distributions


def _visits(spark, d, seed: int) -> DataFrame:
    w = walks.walk(fx.graph(spark, d), fx.nodes(spark, d), 3, seed=seed)
    return w.groupBy("node_id").agg(F.count("*").alias("n"))


_VISITS = [*walk_ctes("g1", "embeds", 3, seed=1, name="ka"), *walk_ctes("g1", "embeds", 3, seed=2, name="kb"), "ca AS (SELECT node_id, count(*) AS n FROM ka GROUP BY node_id)", "cb AS (SELECT node_id, count(*) AS n FROM kb GROUP BY node_id)",
    "both_ AS (SELECT node_id, coalesce(ca.n, 0) AS na, coalesce(cb.n, 0) AS nb FROM ca FULL OUTER JOIN cb USING (node_id))", "tot AS (SELECT sum(na)::DOUBLE AS ta, sum(nb)::DOUBLE AS tb, count(*) AS k FROM both_)"]
_EMBEDS = "embeds AS (SELECT vec_id AS node_id FROM embeddings)"


@query("visit_topn", sql("g1", "SELECT node_id, n, n / (SELECT sum(n) FROM ca)::DOUBLE AS share FROM ca ORDER BY n DESC, node_id LIMIT 25", _EMBEDS, *_VISITS))
def visit_topn(spark, d):
    return div.top_visited(_visits(spark, d, 1), "node_id", 25)


@query("kl_div", sql("g1", f"SELECT {_round('sum(p * ln(p / q))')} AS kl FROM (SELECT (na / ta + 1e-9) / (1 + 1e-9 * k) AS p, (nb / tb + 1e-9) / (1 + 1e-9 * k) AS q FROM both_, tot)", _EMBEDS, *_VISITS))
def kl_div(spark, d):
    return div.kl(_visits(spark, d, 1), _visits(spark, d, 2), "node_id").select(rounded(F.col("kl")).alias("kl"))


@query("js_div", sql("g1", f"SELECT {_round('sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2')} AS js FROM (SELECT na / ta AS p, nb / tb AS q FROM both_, tot)", _EMBEDS, *_VISITS))
def js_div(spark, d):
    return div.js(_visits(spark, d, 1), _visits(spark, d, 2), "node_id").select(rounded(F.col("js")).alias("js"))


@query("ztest_nodes", sql("g1", f"SELECT node_id, {_round('(na / ta - nb / tb) / sqrt(pool * (1 - pool) * (1 / ta + 1 / tb))')} AS z FROM (SELECT *, (na + nb) / (ta + tb) AS pool FROM both_, tot) WHERE pool > 0 AND pool < 1", _EMBEDS, *_VISITS))
def ztest_nodes(spark, d):
    return div.two_proportions(_visits(spark, d, 1), _visits(spark, d, 2), "node_id").select("node_id", rounded(F.col("z")).alias("z"))


def _erfc_sql(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * {x}))"
    power = f"{div.ERFC[-1]!r}::DOUBLE"
    for c in reversed(div.ERFC[:-1]):
        power = f"({c!r}::DOUBLE + {t} * {power})"
    return f"{t} * exp(-{x} * {x} + {power})"


_TESTED = [_EMBEDS, *_VISITS, "zs AS (SELECT *, abs(na / ta - nb / tb) / sqrt(pool * (1 - pool) * (1 / ta + 1 / tb)) / sqrt(2.0::DOUBLE) AS a FROM (SELECT *, (na + nb) / (ta + tb) AS pool FROM both_, tot) WHERE pool > 0 AND pool < 1)"]


@query("ztest_bonf", sql("g1", f"SELECT node_id, {_erfc_sql('a')} < 0.05 / k AS significant FROM zs", *_TESTED))
def ztest_bonf(spark, d):
    """Verdicts; the query compares |z| with the critical value, its SQL the p-value with the level."""
    return div.two_proportions(_visits(spark, d, 1), _visits(spark, d, 2), "node_id").select("node_id", "significant")


@query("ztest_pvalues", sql("g1", f"SELECT node_id, {_round(_erfc_sql('a'))} AS p_value, {_round('100.0::DOUBLE * na / ta', 4)} AS pct_a, {_round('100.0::DOUBLE * nb / tb', 4)} AS pct_b FROM zs", *_TESTED))
def ztest_pvalues(spark, d):
    out = div.two_proportions(_visits(spark, d, 1), _visits(spark, d, 2), "node_id")
    return out.select("node_id", rounded(F.col("p_value")).alias("p_value"), rounded(F.col("pct_a"), 4).alias("pct_a"), rounded(F.col("pct_b"), 4).alias("pct_b"))


@query("edge_visits", sql("g1 seeds", "SELECT edge, count(*) AS n FROM (SELECT concat_ws('_', least(src, dst), greatest(src, dst)) AS edge FROM sampled) GROUP BY edge", *sample_ctes("g1", [4, 3])))
def edge_visits(spark, d):
    edges = smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [4, 3])[1]
    return edges.groupBy(div.undirected_key().alias("edge")).agg(F.count("*").alias("n"))


# ---- set operations that the samplers are built of


@query("set_union", sql("g1", "SELECT src, dst FROM (SELECT dst AS src, src AS dst FROM g1 UNION ALL SELECT src, dst FROM g1)"))
def set_union(spark, d):
    e = fx.graph(spark, d).edges
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("set_except", sql("g1 g2", "SELECT src, dst FROM g1 EXCEPT SELECT src, dst FROM g2"))
def set_except(spark, d):
    return fx.graph(spark, d).edges.join(fx.graph(spark, d, True).edges, ["src", "dst"], "left_anti").distinct()


@query("set_intersect", sql("g1", "SELECT src, dst FROM g1 INTERSECT SELECT dst, src FROM g1"))
def set_intersect(spark, d):
    e = fx.graph(spark, d).edges
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").distinct()


@query("list_functions", "SELECT vec_id AS node_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive, CAST(len(list_distinct(list_transform(embedding, lambda x: CAST(floor(x * 4) AS INTEGER)))) AS BIGINT) AS levels, " + _round("sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))") + " AS norm FROM embeddings")
def list_functions(spark, d):
    h = F.col("features")
    return fx.nodes(spark, d).select("node_id", F.size(F.filter(h, lambda x: x > 0)).cast("long").alias("positive"), F.size(F.array_distinct(F.transform(h, lambda x: F.floor(x * 4).cast("int")))).cast("long").alias("levels"), rounded(F.sqrt(vec.dot(h, h))).alias("norm"))



# ---- further operators of the same families


@query("hybrid_forward", sql("g1 x seeds", out_sql("y"), *sample_ctes("g1", [10, 5]), "degs AS (SELECT v.node_id, count(s.src) AS d FROM visited v LEFT JOIN sampled s ON s.dst = v.node_id GROUP BY v.node_id)",
    "targets AS (SELECT node_id FROM visited WHERE hop = 1)", "rest AS (SELECT node_id FROM visited WHERE hop = 0)", "into1 AS (SELECT src, dst FROM sampled WHERE dst IN (SELECT node_id FROM targets))", f"pre AS ({gcn_sql('into1', 'degs', 'x', 'targets')})",
    "z AS (SELECT v.node_id, x.dim, CASE WHEN v.hop = 2 THEN 0.0::DOUBLE ELSE x.v END AS v FROM visited v JOIN x USING (node_id))", "into0 AS (SELECT src, dst FROM sampled WHERE hop = 1)", f"low AS ({gcn_sql('into0', 'degs', 'z', 'rest')})",
    f"y AS ({linear_sql('(SELECT * FROM pre UNION ALL SELECT * FROM low)', 8)})"))
def hybrid_forward(spark, d):
    """First layer with the frontier's vectors zeroed; the targets' rows come from the pre-aggregated vectors."""
    nodes, edges = smp.fanout(fx.graph(spark, d), fx.seeds(spark, d), [10, 5])
    counted = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("degree"))
    degrees = nodes.join(counted, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    pre = agg.gcn_norm(edges.where("hop = 2"), _x(spark, d), degrees, nodes.where("hop = 1"), DIM)
    own = nodes.join(fx.nodes(spark, d).select("node_id", "features"), "node_id")
    bundle = feat.hybrid_bundle(own, nodes.where("hop = 2"), pre, DIM)
    low = agg.gcn_norm(edges.where("hop = 1"), bundle.select("node_id", "h"), degrees, nodes.where("hop = 0"), DIM)
    rows = bundle.join(low.withColumnRenamed("h", "low"), "node_id", "left").select("node_id", F.coalesce("preagg", "low").alias("h")).where(F.col("h").isNotNull())
    return vec.long_form(rows.select("node_id", vec.linear(F.col("h"), weight(8, DIM), bias(8)).alias("h")), "h")


@query("mean_store", sql("g1 x seeds", f"SELECT s.node_id, x.dim, {_round('coalesce(m.v, 0.0)')} AS h, coalesce(CAST(e.label AS BIGINT), 0) AS target FROM seeds s JOIN x ON x.node_id = s.node_id LEFT JOIN (SELECT p.dst, x.dim, avg(x.v) AS v FROM sampled p JOIN x ON x.node_id = p.src GROUP BY p.dst, x.dim) m ON m.dst = s.node_id AND m.dim = x.dim LEFT JOIN embeddings e ON e.vec_id = s.node_id", *sample_ctes("g1", [3])))
def mean_store(spark, d):
    """Means over the sampled neighbours, zeros without one, with labels, 0 for an absent one."""
    seeds = fx.seeds(spark, d)
    edges = smp.fanout(fx.graph(spark, d), seeds, [3])[1]
    means = agg.aggregate(edges, _x(spark, d), DIM, "mean").select("node_id", F.col("h").alias("features"))
    labels = fx.nodes(spark, d).select("node_id", "target")
    requests = seeds.select(F.col("node_id").alias("pos"), "node_id")
    return vec.long_form(feat.gather(requests, labels.join(means, "node_id", "left"), DIM, missing_label=0).drop("pos"), "h")


@query("status_counts", sql("log", "SELECT user_id, count(*) FILTER (event = 'purchase') AS ok, count(*) FILTER (event = 'error') AS failed, count(*) AS runs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM log) WHERE rn > 1 GROUP BY user_id"))
def status_counts(spark, d):
    rows = ev.after_warmup(fx.log(spark, d), ["user_id"], "event_id", 1)
    return rows.groupBy("user_id").agg(F.count(F.when(F.col("event") == "purchase", 1)).alias("ok"), F.count(F.when(F.col("event") == "error", 1)).alias("failed"), F.count("*").alias("runs"))


@query("latency_segments", f"SELECT l_orderkey, l_linenumber, {_round('greatest(l_quantity - 10, 0.0)')} AS startup, {_round('greatest(l_extendedprice / 1000 - l_quantity, 0.0)')} AS execution, {_round('greatest(l_extendedprice / 500 - l_extendedprice / 1000, 0.0)')} AS receive FROM lineitem")
def latency_segments(spark, d):
    at = [F.lit(10.0), F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_extendedprice") / 500]
    names = ("startup", "execution", "receive")
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[rounded(F.greatest(b - a, F.lit(0.0))).alias(n) for n, a, b in zip(names, at, at[1:], strict=False)])


@query("derived_scalars", sql("log", f"SELECT user_id, {_round('stddev_pop(value) / avg(value)')} AS variation, {_round('sum(value) FILTER (event = chr(101) || chr(114) || chr(114) || chr(111) || chr(114)) / sum(value)')} AS overhead, CAST(arg_min(i, (-value, i)) AS BIGINT) AS steps_to_best FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM log) GROUP BY user_id".replace("chr(101) || chr(114) || chr(114) || chr(111) || chr(114)", "'error'")))
def derived_scalars(spark, d):
    from pyspark.sql import Window

    rows = fx.log(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    out = rows.groupBy("user_id").agg((F.stddev_pop("value") / F.avg("value")).alias("variation"), (F.sum(F.when(F.col("event") == "error", F.col("value"))) / F.sum("value")).alias("overhead"), F.min_by("i", F.struct(-F.col("value"), F.col("i"))).alias("steps_to_best"))
    return out.select("user_id", rounded(F.col("variation")).alias("variation"), rounded(F.col("overhead")).alias("overhead"), "steps_to_best")


@query("profile_totals", "SELECT o_orderkey AS query, CAST(any_value(o_custkey) + coalesce(sum(l_partkey), 0) AS BIGINT) AS hits FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def profile_totals(spark, d):
    return profile_flatten(spark, d).groupBy("query").agg(F.sum("hits").alias("hits"))


@query("ztest_edges", sql("g1 und1 seeds", f"SELECT edge, {_round('(na / ta - nb / tb) / sqrt(pool * (1 - pool) * (1 / ta + 1 / tb))')} AS z FROM (SELECT *, (na + nb) / (ta + tb) AS pool FROM both_, tot) WHERE pool > 0 AND pool < 1", *sample_ctes("g1", [4, 3]),
    "ca AS (SELECT concat_ws('_', least(src, dst), greatest(src, dst)) AS edge, count(*) AS n FROM sampled GROUP BY 1)", "cb AS (SELECT concat_ws('_', least(src, dst), greatest(src, dst)) AS edge, count(*) AS n FROM g1 WHERE dst IN (SELECT node_id FROM seeds) GROUP BY 1)",
    "both_ AS (SELECT edge, coalesce(ca.n, 0) AS na, coalesce(cb.n, 0) AS nb FROM ca FULL OUTER JOIN cb USING (edge))", "tot AS (SELECT sum(na)::DOUBLE AS ta, sum(nb)::DOUBLE AS tb FROM both_)"))
def ztest_edges(spark, d):
    g, s = fx.graph(spark, d), fx.seeds(spark, d)
    count = lambda e: e.groupBy(div.undirected_key().alias("edge")).agg(F.count("*").alias("n"))
    out = div.two_proportions(count(smp.fanout(g, s, [4, 3])[1]), count(smp.fanout(g, s, [-1])[1]), "edge")
    return out.select("edge", rounded(F.col("z")).alias("z"))


@query("resumed_load", sql("nodes g1", "SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT dst FROM g1)"))
def resumed_load(spark, d):
    """Nodes still to load where the targets of all edges are loaded: those without an edge to them."""
    from sparkloom.sources.readers import missing_features

    done = fx.graph(spark, d).edges.select(F.col("dst").alias("node_id"))
    return missing_features(fx.nodes(spark, d).select("node_id"), done)


# ---- stored models, batches, layouts, caches by contract


@query("model_store", "SELECT 'gcn' AS name, 6 AS tensors, CAST(4 + 6 * 8 + 3 * 8 + 3 * 6 + 6 * 4 + 3 * 4 + 4 * (8 * 64 + 8 + 8 * 8 + 8 + 10 * 8 + 10) AS BIGINT) AS bytes")
def model_store(spark, d):
    folder = scratch(spark, "models")
    save_model(spark, folder, "gcn", gcn_spec())
    return list_models(spark, folder)


_STORED = [re.sub(r"(\(\([^()]*\) % \d+ - \d\) / 10\.0::DOUBLE)", r"CAST(CAST(\1 AS FLOAT) AS DOUBLE)", x) for x in gcn_ctes("g1", "g1", "deg1", "x", "x", "x")]


@query("gcn_infer_stored", sql("g1 x deg1", out_sql("y"), *_STORED))
def gcn_infer_stored(spark, d):
    """Logits of all nodes by a model that was stored and loaded; stored tensors have 32 bits."""
    folder = scratch(spark, "models")
    save_model(spark, folder, "gcn", gcn_spec())
    return vec.long_form(infer(fx.graph(spark, d), None, load_model(spark, folder, "gcn")), "h")


@query("gcn_infer_batches", sql("g1 x deg1 seeds", "SELECT node_id, dim, " + _round("v") + " AS h FROM y WHERE node_id IN (SELECT node_id FROM seeds)", *gcn_ctes("g1", "g1", "deg1", "x", "x", "x")))
def gcn_infer_batches(spark, d):
    """Seeds in two batches over all neighbours, so that the batches change no value."""
    seeds, spec = fx.seeds(spark, d), gcn_spec()
    spec.fanouts = [-1, -1]
    out, _ = infer_batches(fx.graph(spark, d), seeds, spec, -(-seeds.count() // 2))
    return vec.long_form(out.select("node_id", "h"), "h")


@query("latency_summary", sql("log", f"SELECT user_id, {_round('quantile_cont(value, 0.5)')} AS p50, {_round('quantile_cont(value, 0.95)')} AS p95, {_round('sum(value) / sum(nodes)')} AS ms_per_node, {_round('sum(nodes) * 1000 / sum(value)')} AS throughput FROM (SELECT *, 1 + event_id % 5 AS nodes FROM log) GROUP BY user_id"))
def latency_summary(spark, d):
    out = ev.latency_summary(fx.log(spark, d).withColumn("nodes", 1 + F.col("event_id") % 5), ["user_id"], "value")
    return out.select("user_id", *[rounded(F.col(c)).alias(c) for c in ("p50", "p95", "ms_per_node", "throughput")])


@query("midpoints", sql("log", f"SELECT user_id, event_id, {_round('(time + before) / 2')} AS middle, value FROM (SELECT *, lag(time) OVER (PARTITION BY user_id ORDER BY time, event_id) AS before FROM log) WHERE before IS NOT NULL"))
def midpoints(spark, d):
    return ev.midpoints(fx.log(spark, d), ["user_id"]).select("user_id", "event_id", rounded(F.col("middle")).alias("middle"), "value")


@query("convergence", sql("log", f"SELECT user_id, best, {_round('min(time) - any_value(start)')} AS converged_after FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS best, min(time) OVER (PARTITION BY user_id) AS start FROM log) WHERE value >= best * 0.99::DOUBLE GROUP BY user_id, best"))
def convergence(spark, d):
    return ev.convergence(fx.log(spark, d), ["user_id"]).select("user_id", "best", rounded(F.col("converged_after")).alias("converged_after"))


@query("outcomes", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS ok, count(*) FILTER (o_orderstatus <> 'O' AND o_orderkey % 3 = 0) AS out_of_memory, count(*) FILTER (o_orderstatus <> 'O' AND o_orderkey % 3 <> 0) AS failed, count(*) AS runs FROM orders GROUP BY o_custkey")
def outcomes(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "ok").otherwise("error")
    message = F.when(F.col("o_orderkey") % 3 == 0, "Java heap: Out of memory").otherwise("timed out")
    return ev.outcomes(fx.table(spark, d, "orders").select("o_custkey", status.alias("status"), message.alias("message")), ["o_custkey"])


@query("server_time", f"SELECT l_orderkey, l_linenumber, {_round('greatest(l_extendedprice / 1000 - l_quantity, 0.0)')} AS server_ms FROM lineitem")
def server_time(spark, d):
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("first"), "l_quantity")
    return ev.server_time(rows, "first", "l_quantity").select("l_orderkey", "l_linenumber", rounded(F.col("server_ms")).alias("server_ms"))


@query("label_encode_seen", "SELECT event_id AS node_id, dense_rank() OVER (ORDER BY first, event_type) - 1 AS code FROM (SELECT event_id, event_type, min(event_id) OVER (PARTITION BY event_type) AS first FROM events)")
def label_encode_seen(spark, d):
    rows = fx.log(spark, d).select(F.col("event_id").alias("node_id"), F.col("event_id").alias("at"), F.col("event").alias("target"))
    return feat.encode_labels_seen(rows, "at")


@query("edge_layout", sql("g1", "SELECT dst, count(*) AS n FROM g1 WHERE dst < (SELECT count(*) FROM embeddings) / 2 GROUP BY dst"))
def edge_layout(spark, d):
    """The lower half of the targets from edges stored in order of them."""
    place, half = scratch(spark, "edges"), fx.nodes(spark, d).count() / 2
    readers.write_sorted(fx.graph(spark, d).edges, place, "dst")
    return spark.read.parquet(place).where(F.col("dst") < half).groupBy("dst").agg(F.count("*").alias("n"))


@query("visit_dump", sql("g1", "SELECT node_id, n FROM ca", _EMBEDS, *_VISITS))
def visit_dump(spark, d):
    """Counts of visits as JSON, read again."""
    place = scratch(spark, "visits")
    readers.write_json(_visits(spark, d, 1), place)
    return spark.read.schema("node_id long, n long").json(place)


@query("float_materialise", sql("nodes", f"SELECT node_id, {_round('CAST(features[3] AS DOUBLE)')} AS x2, CAST(len(features) AS BIGINT) AS dims FROM nodes"))
def float_materialise(spark, d):
    """Packed features as doubles, resumed from the training nodes."""
    rows = fx.nodes(spark, d)
    done = rows.where("split = 'train'").select("node_id", "features")
    out = readers.materialise(rows.select("node_id", vec.pack_floats("features").alias("features")), done)
    return out.select("node_id", rounded(F.col("features")[2]).alias("x2"), F.size("features").cast("long").alias("dims"))


@query("cache_contract", sql("x", f"SELECT r.node_id, {_round('CASE WHEN r.node_id = 14 THEN 7.0 WHEN r.node_id = 21 THEN NULL ELSE x.v END')} AS x0 FROM (SELECT DISTINCT o_custkey AS node_id FROM orders) r LEFT JOIN (SELECT * FROM x WHERE dim = 0) x ON x.node_id = r.node_id"))
def cache_contract(spark, d):
    """Rows put in, one replaced, one deleted, and many looked up."""
    cache = caches.TableCache(spark, _x(spark, d))
    cache.set(14, [7.0])
    cache.delete(21)
    return cache.get_many(_requests(spark, d)).select("node_id", rounded(F.col("h")[0]).alias("x0"))


@query("saint_rw_random", sql("g1 nodes", "SELECT DISTINCT node_id FROM (SELECT here AS node_id FROM c0 UNION ALL SELECT here FROM c1 UNION ALL SELECT here FROM c2)",
    f"c0 AS (SELECT node_id AS walker, node_id AS here FROM nodes ORDER BY {_tape('root', 'node_id')}, node_id LIMIT 60)",
    *[f"c{s} AS (SELECT a.walker, coalesce(b.dest, a.here) AS here FROM c{s - 1} a LEFT JOIN (SELECT dst, src AS dest FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY {_tape(s, 'dst', 'src')}) AS rn FROM g1) WHERE rn = 1) b ON b.dst = a.here)" for s in (1, 2)]))
def saint_rw_random(spark, d):
    """Distinct nodes of coalescing walks from random roots."""
    g = fx.graph(spark, d)
    return walks.walk(g, walks.roots(g.nodes, 60), 2, coalesce=True).select("node_id").distinct()


@query("induced_nodes", sql("nodes", "SELECT node_id, split, CAST(target AS BIGINT) AS target, CAST(features[1] AS DOUBLE) AS x0 FROM nodes WHERE split <> 'train'"))
def induced_nodes(spark, d):
    """The nodes of an induced subgraph keep their properties, isolated ones too."""
    g = fx.graph(spark, d)
    return g.induced(g.nodes.where("split <> 'train'")).nodes.select("node_id", "split", F.col("target").cast("long").alias("target"), F.col("features")[0].cast("double").alias("x0"))


@query("subgraph_disagreement", sql("g1 g2", "SELECT 'nodes' AS kind, CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b UNION ALL SELECT 'edges', (SELECT count(*) FROM (SELECT * FROM g1 EXCEPT ALL SELECT * FROM g2)), (SELECT count(*) FROM (SELECT * FROM g2 EXCEPT ALL SELECT * FROM g1))"))
def subgraph_disagreement(spark, d):
    return disagreement(fx.graph(spark, d), fx.graph(spark, d, True))


@query("node_totals", sql("g1 nodes", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM g1) AS edges, (SELECT count(DISTINCT src) FROM g1) AS sources, (SELECT count(DISTINCT dst) FROM g1) AS targets"))
def node_totals(spark, d):
    g = fx.graph(spark, d)
    return g.nodes.agg(F.count("*").alias("nodes")).join(g.edges.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets")))


@query("train_mask", sql("nodes", "SELECT node_id, split = 'train' AS train FROM nodes"))
def train_mask(spark, d):
    """Splits as names or as numbers, where 0 is training."""
    rows = fx.nodes(spark, d).select("node_id", F.when(F.col("node_id") % 2 == 0, F.col("split")).otherwise(F.when(F.col("split") == "train", "0").when(F.col("split") == "val", "1").otherwise("2")).alias("split"))
    return rows.select("node_id", smp.is_train("split").alias("train"))


from sparkloom.plans import graph_queries  # noqa: E402, F401  registers more queries
