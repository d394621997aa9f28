"""Stored models, batches, caches, archives and further readers."""

import io
import math
import tarfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import vectors as vec
from sparkloom.graph import PropertyGraph, disagreement
from sparkloom.operators import caches, walks
from sparkloom.operators import divergence as div
from sparkloom.operators import events as ev
from sparkloom.operators import features as feat
from sparkloom.plans.batched import infer_batches
from sparkloom.plans.planner import infer
from sparkloom.plans.spec import Layer, ModelSpec, compile_layers
from sparkloom.plans.store import list_models, load_model, save_model
from sparkloom.sources import readers

EDGES = [(i, (3 * i + k) % 12) for i in range(12) for k in (1, 4) if i != (3 * i + k) % 12]


@pytest.fixture(scope="module")
def small(spark):
    x = np.random.default_rng(5).normal(size=(12, 3)).astype(np.float32)
    nodes = spark.createDataFrame([(i, x[i].tolist(), i % 3, "train") for i in range(12)], "node_id long, features array<float>, target long, split string")
    return PropertyGraph(nodes, spark.createDataFrame(EDGES, "src long, dst long")), x.astype(float)


def spec():
    rng = np.random.default_rng(6)
    tensors = {f"{n}.{k}": rng.normal(size=s).tolist() for n, o, i in (("a", 4, 3), ("b", 2, 4)) for k, s in (("weight", (o, i)), ("bias", (o,)))}
    return ModelSpec(2, [-1, -1], compile_layers([("conv", "a", True), ("conv", "b")]), tensors)


def table(h):
    return {r.node_id: r.h for r in h.collect()}


def test_models_are_stored(spark, small, tmp_path):
    folder = str(tmp_path / "models")
    assert save_model(spark, folder, "one", spec()) == (f"{folder}/one", 4)
    assert save_model(spark, folder, "one", spec())[1] == 4
    back = load_model(spark, folder, "one")
    assert back.layers == spec().layers and back.fanouts == [-1, -1]
    assert [(r.name, r.tensors) for r in list_models(spark, folder).collect()] == [("one", 4)]
    a, b = table(infer(small[0], None, spec())), table(infer(small[0], None, back))
    assert all(np.allclose(a[i], b[i], atol=1e-5) for i in range(12))
    with pytest.raises(ValueError):
        save_model(spark, folder, "../out", spec())


def test_batches_change_no_value(spark, small):
    want = table(infer(small[0], None, spec()))
    out, spent = infer_batches(small[0], small[0].nodes.select("node_id"), spec(), 5)
    got = table(out.select("node_id", "h"))
    assert len(got) == 12 and all(np.allclose(got[i], want[i]) for i in range(12))
    assert sorted((r.batch_id, r.nodes) for r in spent.collect()) == [(0, 5), (1, 5), (2, 2)]
    assert ev.latency_summary(spent, []).first()["ms_per_node"] > 0
    none, spent = infer_batches(small[0], small[0].nodes.select("node_id").limit(0), spec(), 5)
    assert none.count() == spent.count() == 0


def test_gin_and_attention_in_a_specification(spark, small):
    g, x = small
    into = {v: [a for a, b in EDGES if b == v] for v in range(12)}
    eye = np.eye(3).tolist()
    gin = ModelSpec(1, [-1], [Layer("aggregate", "gin", eps=0.5), Layer("softmax")], {"w": eye})
    got = table(infer(g, None, gin))
    for v in range(12):
        raw = 1.5 * x[v] + sum((x[u] for u in into[v]), np.zeros(3))
        assert np.allclose(got[v], np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum())
    heads = [[0.3, -0.2, 0.5], [-0.4, 0.1, 0.2]]
    gat = ModelSpec(1, [-1], [Layer("aggregate", "attention", weight="a")], {"a": heads})
    got = table(infer(g, g.nodes.select("node_id"), gat))
    for v in (v for v in range(12) if into[v]):
        e = np.array([np.dot(heads[0], x[v]) + np.dot(heads[1], x[u]) for u in into[v]])
        w = np.exp(np.where(e > 0, e, 0.2 * e))
        assert np.allclose(got[v], (w / w.sum()) @ x[into[v]])
    with pytest.raises(ValueError):
        ModelSpec(1, [-1], [Layer("aggregate", "attention", weight="a")], {"a": [[1.0]]}).check()


def test_caches(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (None, [9.0]), (2, [3.0])], caches.SCHEMA)
    cache = caches.TableCache(spark, rows)
    assert cache.get(2) == [3.0] and cache.get(5) is None and cache.rows.count() == 2
    cache.set(1, [4.0])
    cache.delete(2)
    asked = spark.createDataFrame([(1,), (2,), (1,)], "node_id long")
    assert table(cache.get_many(asked)) == {1: [4.0], 2: None}
    cache.clear()
    assert cache.get(1) is None
    fixed = caches.FixedCache(spark, rows)
    with pytest.raises(ValueError):
        fixed.set(7, [0.0])
    open_ = caches.FixedCache(spark)
    open_.set(7, [0.0])
    open_.freeze()
    with pytest.raises(ValueError):
        open_.clear()
    near = caches.TableCache(spark)
    both = caches.TieredCache(near, open_, fixed)
    got = {r.node_id: (r.h, r.tier) for r in both.get_many(asked.unionByName(asked.selectExpr("node_id + 6 AS node_id"))).collect()}
    assert got == {1: ([1.0], 2), 2: ([3.0], 2), 7: ([0.0], 1), 8: (None, None)} and near.rows.isEmpty()
    assert both.get(1) == [1.0] and near.get(1) == [1.0] and open_.get(1) is None and both.get(8) is None
    nothing = caches.NoCache(spark, rows)
    assert nothing.get(1) is None and table(nothing.get_many(asked)) == {1: None, 2: None}


def test_two_levels(spark):
    requests = spark.createDataFrame([(0, i, n) for i, n in enumerate([1, 2, 3, 2, 1, 4, 3, 2])], "cache_id long, pos long, node_id long")
    got = caches.two_level(requests, spark.createDataFrame([(1,)], "node_id long"), 2)
    assert [r.tier for r in got.orderBy("pos").collect()] == [0, None, None, 1, 0, None, None, None]


def test_samples_cover(spark, small):
    g = small[0]
    samples = walks.covering_samples(g, 3, 2, 2.0)
    sizes = [r.n for r in samples.groupBy("sample").agg(F.count("*").alias("n")).orderBy("sample").collect()]
    assert sum(sizes) >= 24 > sum(sizes[:-1])
    assert walks.covering_samples(PropertyGraph(g.nodes.limit(0), g.edges), 3, 2).count() == 0


def test_disagreement(spark, small):
    g = small[0]
    other = PropertyGraph(g.nodes.where("node_id > 0"), g.edges.unionByName(g.edges.limit(1)))
    assert {r.kind: (r.only_a, r.only_b) for r in disagreement(g, other).collect()} == {"nodes": (1, 0), "edges": (0, 1)}


def test_erfc(spark):
    xs = [0.0, 1e-6, 0.3, 1.0, 2.5, 5.0, 9.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", div.erfc(F.col("x")).alias("y")).collect()
    assert all(math.isclose(r.y, math.erfc(r.x), rel_tol=2e-7) for r in rows)


def test_first_seen_labels(spark):
    rows = spark.createDataFrame([(1, 4, "b"), (2, 2, "c"), (3, 9, "c"), (4, 1, None), (5, 2, "a")], "node_id long, at long, target string")
    assert {r.node_id: r.code for r in feat.encode_labels_seen(rows, "at").collect()} == {1: 2, 2: 1, 3: 1, 4: -1, 5: 0}


def test_archives_and_chunks(spark, tmp_path):
    with tarfile.open(tmp_path / "set.tgz", "w:gz") as out:
        for name, text in (("set/x.content", "7\t1\t0\tred\n8\t0\t1\tblue\n"), ("set/x.cites", "7\t8\n"), ("set/README", "no\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            out.addfile(info, io.BytesIO(text.encode()))
    place = str(tmp_path / "set.tgz")
    assert [(r.node_id, r.features, r.target) for r in readers.read_content(spark, place, 2).orderBy("node_id").collect()] == [(7, [1.0, 0.0], "red"), (8, [0.0, 1.0], "blue")]
    assert [tuple(r) for r in readers.read_citations(spark, place).collect()] == [(8, 7)]
    (tmp_path / "chunks").mkdir()
    chunk = pa.table({"dst": pa.array([2, 3], pa.int32()), "src": [0, 1], "more": ["x", "y"]})
    with pa.ipc.new_file(str(tmp_path / "chunks" / "a.arrow"), chunk.schema) as out:
        out.write_table(chunk)
    with pa.ipc.new_stream(str(tmp_path / "chunks" / "b.arrows"), chunk.schema) as out:
        out.write_table(chunk.slice(1))
    got = readers.read_arrow(spark, str(tmp_path / "chunks"), "src long, dst long")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 2), (1, 3), (1, 3)]


def test_materialised_floats(spark):
    rows = spark.createDataFrame([(1, [1.5, 2.0]), (2, [3.0, 4.0]), (3, None)], "node_id long, features array<float>")
    packed = rows.select("node_id", vec.pack_floats("features").alias("features"))
    done = spark.createDataFrame([(2, [9.0, 9.0])], "node_id long, features array<double>")
    assert {r.node_id: r.features for r in readers.materialise(packed, done).collect()} == {1: [1.5, 2.0], 2: [9.0, 9.0], 3: None}


def test_resumed_load_asks_every_edge(spark, tmp_path):
    import duckdb

    from sparkloom.plans import catalog

    # four nodes; edges 1 -> 0, 3 -> 0 and, of an order that no fortieth holds and a line that was not returned, 3 -> 2; 1 -> 1 is none
    spark.createDataFrame([(i, [1.0], 0) for i in range(4)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    lines = [(1, 1, 1, "R"), (1, 3, 1, "R"), (3, 3, 1, "N"), (2, 1, 1, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(r.node_id for r in catalog.QUERIES["resumed_load"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(r[0] for r in con.execute(catalog.SQL["resumed_load"]).fetchall()) == [1, 3]


def test_outcomes_and_convergence(spark):
    runs = spark.createDataFrame([("a", "ok", None), ("a", "error", "CUDA OOM"), ("a", "error", None), ("a", None, "out of memory")], "k string, status string, message string")
    assert tuple(ev.outcomes(runs, ["k"]).first()) == ("a", 1, 2, 1, 4)
    log = spark.createDataFrame([(i, float(i), v) for i, v in enumerate([0.1, 0.5, 0.995, 1.0])], "event_id long, time double, value double").withColumn("k", F.lit(1))
    assert tuple(ev.convergence(log, ["k"]).first()) == (1, 1.0, 2.0)
    assert [r.middle for r in ev.midpoints(log, ["k"]).orderBy("event_id").collect()] == [0.5, 1.5, 2.5]
