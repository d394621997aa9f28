"""Sums over closed paths against numpy, by blocks and through tensor expressions; none of them joins paths of two edges."""

import random

import numpy as np
import pytest

from sparkloom.graph import PropertyGraph
from sparkloom.operators import closed, packed
from sparkloom.plans import tensor as t

N = 14


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(8)
    far = [i if i < 9 else -(2**60) + i * 2**58 for i in range(N)]  # ids as far apart as they get
    sides, frames = [], []
    for _ in range(3):
        pairs = [(rng.randrange(N), rng.randrange(N), rng.choice([1.0, -2.0, 0.5])) for _ in range(60)] + [(2, i, 1.0) for i in range(N)] * 2 + [(i, 2, 1.0) for i in range(N)]
        dense = np.zeros((N, N))
        for a, b, v in pairs:
            dense[a, b] += v
        sides.append(dense)
        frames.append(spark.createDataFrame([(far[a], far[b], v) for a, b, v in pairs], "a long, b long, val double"))
    return far, sides, frames


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("p", [1, 3])
@pytest.mark.parametrize("keep", [(), ("x",), ("y",), ("x", "y")])
def test_blocks(data, keep, p, small, monkeypatch):
    if small:
        monkeypatch.setattr(closed, "CELLS", 20)
        monkeypatch.setattr(closed, "PATHS", 7)
        monkeypatch.setattr(packed, "PIECE", 11)
    far, (a, b, c), (mask, onward, back) = data
    want = a * (b @ c).T
    want = want if keep == ("x", "y") else want.sum(axis=1) if keep == ("x",) else want.sum(axis=0) if keep else want.sum()
    got = np.zeros_like(want)
    turned = packed.pack(back.selectExpr("b AS a", "a AS b", "val"))
    for r in closed.closed_sums((packed.pack(mask), False), (packed.pack(onward), False), (turned, True), keep, p).collect():
        got[tuple(far.index(r[k]) for k in keep)] += r.val
    assert np.allclose(got, want)


def test_plain_pairs_and_none(spark):
    pairs = sorted({(random.Random(i).randrange(40), random.Random(-i - 1).randrange(40)) for i in range(500)})
    dense = np.zeros((40, 40))
    for a, b in pairs:
        dense[a, b] = 1
    pieces = packed.pack(spark.createDataFrame(pairs, "a long, b long")), False
    assert sum(r.val for r in closed.closed_sums(pieces, pieces, pieces, p=2).collect()) == np.trace(dense @ dense @ dense)
    nothing = packed.pack(spark.createDataFrame([], "a long, b long")), False
    assert closed.closed_sums(pieces, nothing, pieces).collect() == []


E, Y = t.Edge, lambda v: t.Feature("y", v)
RINGS = {
    "closed walks": (t.triangles(), lambda a, w, y: np.trace(a @ a @ a)),
    "of a node": (t.Sum("y", t.Sum("z", E("x", "y") * E("y", "z") * E("z", "x"))), lambda a, w, y: np.diag(a @ a @ a)),
    "transitive, of the last node": (t.Sum("x", t.Sum("z", E("x", "y") * E("x", "z") * E("z", "y"))), lambda a, w, y: (a * (a @ a)).sum(axis=0)),
    "over an edge": (E("a", "b") * t.Sum("z", E("z", "a") * E("b", "z")), lambda a, w, y: a * (a @ a).T),
    "weights and numbers": (3 * t.Sum("x", t.Sum("y", t.Sum("z", Y("x") * E("x", "y", "w") * E("y", "z") * Y("z") * E("x", "z", "w") * 2))), lambda a, w, y: 6 * (w * ((w * y) @ a.T) * y[:, None]).sum()),
}


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    edges = sorted({(rng.randrange(N), rng.randrange(N)) for _ in range(70)} | {(2, i) for i in range(N)} | {(i, 2) for i in range(N)})
    a, w, y = np.zeros((N, N)), np.zeros((N, N)), np.array([float(i % 4) for i in range(N)])
    rows = [(u, v, float(rng.randint(-1, 3))) for u, v in edges]
    for u, v, x in rows:
        a[u, v], w[u, v] = 1, x
    return PropertyGraph(spark.createDataFrame([(i, float(y[i])) for i in range(N)], "node_id long, y double"), spark.createDataFrame(rows, "src long, dst long, w double")), a, w, y


@pytest.mark.parametrize("name", RINGS)
def test_rings(graph, name):
    e, want = RINGS[name]
    names = sorted(t.free(e))
    out = t.evaluate(graph[0], e)
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan
    got = np.zeros((N,) * len(names))
    for r in out.collect():
        got[tuple(r[v] for v in names)] += r.val
    assert np.allclose(got, want(*graph[1:]))


def test_a_sum_without_a_closing_guard_is_no_ring():
    assert t._ring(t.Sum("y", t.Sum("z", E("x", "y") * E("y", "z")))) is None
    assert t._ring(t.Sum("z", E("x", "y") * E("y", "z") * t.Sum("z", E("z", "x")))) is None
