"""Inference against numpy, sampling invariants, codecs, readers, caches and streams."""

from collections import OrderedDict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import vectors as vec
from sparkloom.graph import PropertyGraph
from sparkloom.operators import divergence as div
from sparkloom.operators import events as ev
from sparkloom.operators import features as feat
from sparkloom.operators import sampling as smp
from sparkloom.operators import walks
from sparkloom.plans.planner import infer, predict
from sparkloom.plans.spec import Layer, ModelSpec, compile_layers, read_tensors, write_tensors
from sparkloom.sources import readers
from sparkloom.streaming import events as stream

EDGES = [(0, 5), (2, 5), (6, 5), (5, 2), (1, 2), (3, 1), (7, 1), (4, 3), (0, 6), (4, 6), (1, 7)]


def tiny(spark, dim=4, n=8, edges=EDGES):
    x = np.random.default_rng(2611).normal(size=(n, dim)).astype(np.float32)
    nodes = spark.createDataFrame([(i, x[i].tolist(), i % 3, "train") for i in range(n)], "node_id long, features array<float>, target long, split string")
    return PropertyGraph(nodes, spark.createDataFrame(edges, "src long, dst long")), x.astype(np.float64)


def gcn(x, edges, n):
    d = np.zeros(n)
    for _, v in edges:
        d[v] += 1
    out = x / (d + 1)[:, None]
    for u, v in edges:
        out[v] += x[u] / np.sqrt((d[v] + 1) * (d[u] + 1))
    return out


def model(rng, sizes):
    tensors = {}
    for name, (i, o) in zip("abc", sizes, strict=True):
        tensors[f"{name}.weight"], tensors[f"{name}.bias"] = rng.normal(size=(o, i)).tolist(), rng.normal(size=o).tolist()
    return ModelSpec(2, [-1, -1], compile_layers([("conv", "a", True), ("conv", "b", True), ("linear", "c")]), tensors)


@pytest.mark.parametrize("rewrite", [True, False])
@pytest.mark.parametrize("whole", [True, False])
def test_inference_matches_numpy(spark, rewrite, whole):
    g, x = tiny(spark)
    spec = model(np.random.default_rng(1), [(4, 6), (6, 3), (3, 3)])
    h = x
    for name in "ab":
        h = np.maximum(gcn(h, EDGES, 8) @ np.array(spec.tensors[f"{name}.weight"]).T + spec.tensors[f"{name}.bias"], 0)
    want = h @ np.array(spec.tensors["c.weight"]).T + spec.tensors["c.bias"]
    got = infer(g, None if whole else g.nodes.select("node_id"), spec, rewrite=rewrite)
    rows = {r.node_id: r.h for r in got.collect()}
    assert np.allclose([rows[i] for i in range(8)], want)
    assert {r.node_id: r.predicted for r in predict(got).collect()} == {i: int(np.argmax(want[i].round(6))) for i in range(8)}


def test_specs_are_checked():
    spec = ModelSpec.parse('{"num_hops": 1, "max_neighbors": 5, "layers": [{"op": "aggregate", "method": "mean"}]}', {})
    assert spec.fanouts == [5]
    for bad in (
        ModelSpec(2, [5, 5], [Layer("aggregate", "mean")]),
        ModelSpec(1, [5, 5], [Layer("aggregate", "mean")]),
        ModelSpec(1, [5], [Layer("aggregate", "median")]),
        ModelSpec(1, [5], [Layer("aggregate", "mean"), Layer("linear", weight="w")]),
        ModelSpec(0, [], [Layer("dropout")]),
    ):
        with pytest.raises(ValueError):
            bad.check()
    with pytest.raises(ValueError):
        compile_layers([("lstm", "x")])
    assert [x.op for x in compile_layers([[("gelu",), ("tanh",)], ("linear", "c")])] == ["relu", "tanh", "linear"]


def test_tensors_round_trip():
    tensors = {"w": [[1.0, 2.5], [-0.5, 0.0], [3.0, 4.0]], "b": [0.25, -1.0]}
    assert read_tensors(write_tensors(tensors)) == tensors


def test_codecs(spark):
    df = spark.createDataFrame([([1.0, 2.5, -0.30000001192092896, 0.0], 2**31), ([], -1), (None, None)], "v array<float>, y long")
    rows = df.select("v", vec.unpack_floats(vec.pack_floats("v")).alias("w"), vec.pack_floats("v").alias("b"), "y", vec.unpack_label(vec.pack_label("y")).alias("z")).collect()
    assert all(r.v == r.w and r.y == r.z for r in rows) and rows[0].b == np.array([1.0, 2.5, -0.3, 0.0], "<f4").tobytes()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), min_size=1, max_size=40, unique=True), st.lists(st.integers(-1, 3).filter(lambda k: k != 0), min_size=1, max_size=3))
def test_sampling_invariants(spark, edges, fanouts):
    g, _ = tiny(spark, n=12, edges=edges)
    nodes, drawn = smp.fanout(g, spark.createDataFrame([(0,), (3,), (3,), (99,)], "node_id long"), fanouts)
    hops = {r.node_id: r.hop for r in nodes.collect()}
    rows = [(r.hop, r.src, r.dst) for r in drawn.collect()]
    assert len(set(rows)) == len(rows) and {(s, d) for _, s, d in rows} <= set(edges)
    assert {i for i, h in hops.items() if h == 0} == {0, 3}
    for hop, k in enumerate(fanouts, 1):
        for v in {i for i, h in hops.items() if h == hop - 1}:
            degree, got = sum(d == v for _, d in edges), sum(h == hop and d == v for h, _, d in rows)
            assert got == (degree if k < 0 else min(k, degree))
    assert set(hops) == {0, 3} | {s for _, s, _ in rows}


def test_walks_stay_on_edges(spark):
    g, _ = tiny(spark)
    rows = walks.walk(g, g.nodes.select("node_id"), 3).collect()
    at = {(r.walker, r.step): r.node_id for r in rows}
    for (w, s), v in at.items():
        if s:
            u = at[w, s - 1]
            assert (v, u) in EDGES or (v == u and not any(d == u for _, d in EDGES))


def test_uniform_draws(spark):
    """The tape draws like a uniform sampler: KL to the uniform distribution is small."""
    edges = [(i, 0) for i in range(1, 11)]
    g, _ = tiny(spark, n=11, edges=edges)
    view = g.view()
    seen = np.zeros(11)
    for seed in range(60):
        for r in smp.expand(view, spark.createDataFrame([(0,)], "node_id long"), 5, 1, seed).collect():
            seen[r.src] += 1
    p = seen[1:] / seen.sum()
    assert (p * np.log(p * 10)).sum() < 0.03


def test_seed_rules(spark):
    g, _ = tiny(spark)
    assert [r.node_id for r in smp.split_seeds(g.nodes, "train", limit=5, offset=2).collect()] == [2, 3, 4]
    assert [r.node_id for r in smp.page(g.nodes, "train", 5, 2).collect()] == [2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        smp.split_seeds(g.nodes, "dev")
    with pytest.raises(ValueError):
        smp.split_seeds(g.nodes, "train", offset=1, shuffle=True)
    shards = [{r.node_id for r in smp.shard(g.nodes, k, 3).collect()} for k in range(3)]
    assert set.union(*shards) == set(range(8)) and sum(map(len, shards)) == 8
    assert {r.local_id: r.node_id for r in smp.dense_index(g.nodes.select("node_id"), "node_id").collect()} == {i: i for i in range(8)}


def test_lru_matches_replay(spark):
    rng = np.random.default_rng(4)
    rows = [(int(c), i, int(n)) for c in (0, 1) for i, n in enumerate(rng.integers(0, 12, 200))]
    got = {(r.cache_id, r.pos): r.hit for r in feat.lru(spark.createDataFrame(rows, "cache_id long, pos long, node_id long"), 5).collect()}
    for c in (0, 1):
        state = OrderedDict()
        for cache, i, n in rows:
            if cache == c:
                assert got[c, i] == (n in state)
                state[n] = None
                state.move_to_end(n)
                if len(state) > 5:
                    state.popitem(last=False)
    assert feat.cache_capacity(1000, 64) == 3 and feat.cache_capacity(1024, 64, 0) == 4


def test_hybrid_and_missing(spark):
    g, x = tiny(spark)
    req = spark.createDataFrame([(0, 3), (1, 99), (2, 3)], "pos long, node_id long")
    rows = sorted(feat.gather(req, g.nodes, 4).collect())
    assert [r.target for r in rows] == [0, -1, 0] and rows[1].h == [0.0] * 4 and np.allclose(rows[0].h, x[3])
    assert [r.pos for r in sorted(feat.fetch(req, g.nodes).collect())] == [0, 2]
    bundle = {r.node_id: r for r in feat.hybrid_bundle(g.nodes, spark.createDataFrame([(1,)], "node_id long"), spark.createDataFrame([(2, [1.0] * 4)], "node_id long, h array<double>"), 4).collect()}
    assert bundle[1].h == [0.0] * 4 and bundle[2].preagg == [1.0] * 4 and bundle[3].preagg is None


def test_divergence_of_equal_samples(spark):
    a = spark.createDataFrame([(1, 10), (2, 30), (3, 0)], "node_id long, n long")
    b = spark.createDataFrame([(1, 100), (2, 300)], "node_id long, n long")
    assert abs(div.kl(a, b, "node_id").first().kl) < 1e-6 and abs(div.js(a, b, "node_id").first().js) < 1e-12
    c = spark.createDataFrame([(1, 300), (2, 100)], "node_id long, n long")
    assert all(r.significant for r in div.two_proportions(b, c, "node_id").collect())


def test_early_stop(spark):
    rows = [(0, i, v) for i, v in enumerate([1.0, 2.0, 1.9, 1.8, 2.05, 3.0])] + [(1, 0, 5.0)]
    got = {r.run: (r.stopped_at, r.best) for r in ev.early_stop(spark.createDataFrame(rows, "run long, i long, v double"), "run", "i", "v", 3, 0.1).collect()}
    assert got == {0: (5, 2.0), 1: (None, 5.0)}


@pytest.mark.parametrize("turned", [False, True])
def test_array_files(spark, tmp_path, turned):
    x, e = np.arange(60, dtype=np.float32).reshape(20, 3), np.array([[0, 1, 2, 5, 6], [3, 4, 5, 7, 8]])
    np.savez(f"{tmp_path}/a.npz", x=x, e=e.T.copy() if turned else e)
    spark.dataSource.register(readers.ArraySource)
    rows = spark.read.format("npz_rows").option("path", f"{tmp_path}/a.npz").option("name", "x").option("chunk", "7").load().collect()
    assert np.allclose([r["values"] for r in sorted(rows)], x)
    edges = spark.read.format("npz_rows").option("path", f"{tmp_path}/a.npz").option("name", "e").option("kind", "edges").option("chunk", "2").load()
    assert sorted(map(tuple, edges.collect())) == sorted(zip(*e.tolist(), strict=True))


def test_text_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("31\t1\t0\tTheory\n32\t0\t1\tCases\n")
    (tmp_path / "e.tsv").write_text("31\t32\n")
    (tmp_path / "s.csv").write_text("31\n")
    nodes = readers.read_content(spark, f"{tmp_path}/c.tsv", 2)
    assert sorted((r.node_id, r.features, r.target) for r in nodes.collect()) == [(31, [1.0, 0.0], "Theory"), (32, [0.0, 1.0], "Cases")]
    assert readers.read_citations(spark, f"{tmp_path}/e.tsv").collect()[0] == (32, 31)
    assert {r.node_id: r.split for r in readers.assign_splits(nodes, [readers.read_split(spark, f"{tmp_path}/s.csv", "train")]).collect()} == {31: "train", 32: "unknown"}
    log = spark.createDataFrame([("a", 1.5, 2.0)], "event string, time double, value double")
    readers.write_metrics(log, f"{tmp_path}/m")
    assert readers.read_metrics(spark, f"{tmp_path}/m").collect() == log.collect()


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, ("view", "click")[i % 2], float(i)) for i in range(60)]
    log = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("props", F.lit("{}"))
    log.write.parquet(f"{tmp_path}/in")
    for name, made in (("stats", stream.windowed_stats(stream.read_log(spark, f"{tmp_path}/in"))), ("spans", stream.spans(stream.read_log(spark, f"{tmp_path}/in"), "view", "click", "5 minutes"))):
        made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    every = spark.table("spans").collect()
    assert every and all(0 <= r.micros <= 300_000_000 for r in every)
    want = sum(1 for a in rows for b in rows if a[3] == "view" and b[3] == "click" and a[2] == b[2] and 0 <= b[0] - a[0] <= 5)
    assert len(every) == want


def test_dense_index_numbers_rows_with_payload(spark):
    n = 1_200_000
    rows = spark.range(n, numPartitions=6).select(F.xxhash64("id").alias("t"), F.col("id"), F.sha1(F.col("id").cast("string")).alias("payload"))
    out = smp.dense_index(rows, "t", "id").agg(F.count_distinct("local_id").alias("n"), F.min("local_id").alias("lo"), F.max("local_id").alias("hi"), F.sum(F.col("local_id") * F.pmod("id", F.lit(97))).alias("s")).first()
    assert (out.n, out.lo, out.hi) == (n, 0, n - 1)
    t = spark.range(n).select(F.xxhash64("id").alias("t"), F.col("id")).toPandas().sort_values(["t", "id"])
    assert out.s == int((np.arange(n) * (t["id"].to_numpy() % 97)).sum())


def test_grid_matches_numpy(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for name, n in (("a", 400), ("b", 3), ("c", 1)):
        times = np.sort(rng.uniform(0, 100, n)) if n != 400 else np.sort(np.concatenate([rng.uniform(0, 1, 200), rng.uniform(99, 100, 200)]))
        values = rng.normal(size=n)
        rows += [(name, float(t), float(v)) for t, v in zip(times, values, strict=True)]
        grid = times[0] + (times[-1] - times[0]) * np.arange(50) / 49
        want[name] = np.interp(grid, times, values)
    out = ev.on_grid(spark.createDataFrame(rows, "event string, time double, value double"), "event", 50).collect()
    assert len(out) == 150 and all(abs(r.value - want[r.event][r.i]) < 1e-9 for r in out)


def test_profiles_are_flattened_to_the_end_of_the_schema(spark):
    kind, value = "struct<operator: string, time: double, hits: long>", ("op10", 1.0, 1)
    for i in range(9, -1, -1):
        kind, value = f"struct<operator: string, time: double, hits: long, children: array<{kind}>>", (f"op{i}", 1.0, 1, [value])
    rows = spark.createDataFrame([(1, value)], f"query long, plan {kind}")
    assert sorted(r.operator for r in ev.flatten_profile(rows).collect()) == sorted(f"op{i}" for i in range(11))


def test_codecs_keep_nulls(spark):
    rows = spark.createDataFrame([(1, [1.5, -2.0], 7), (2, None, None), (3, [], -1), (4, [3.25], 2**40)], "i long, x array<float>, y long").repartition(1)
    packed = rows.select("i", "x", "y", vec.pack_floats("x").alias("b"), vec.pack_label("y").alias("c"))
    for r in packed.select("*", vec.unpack_floats("b").alias("x2"), vec.unpack_label("c").alias("y2")).collect():
        assert r.x == r.x2 and r.y == r.y2 and (r.b is None or bytes(r.b) == np.array(r.x, "<f4").tobytes())


def test_absent_label_of_mean_store(spark):
    nodes = spark.createDataFrame([(1, [1.0, 2.0], None)], "node_id long, features array<double>, target long")
    asked = spark.createDataFrame([(0, 1), (1, 9)], "pos long, node_id long")
    assert [(r.target, r.h) for r in feat.gather(asked, nodes, 2, missing_label=0).orderBy("pos").collect()] == [(0, [1.0, 2.0]), (0, [0.0, 0.0])]
    assert {r.target for r in feat.gather(asked, nodes, 2).collect()} == {-1}
