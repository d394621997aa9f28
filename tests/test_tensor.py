"""Tensor expressions against dense numpy arrays, and what is refused."""

import random

import numpy as np
import pytest

from sparkloom.graph import PropertyGraph
from sparkloom.plans import tensor as t

N = 9


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    edges = sorted({(rng.randrange(N), rng.randrange(N)) for _ in range(26)})
    weights = [float(rng.randint(1, 5)) for _ in edges]
    x = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(N)]
    y = [float(rng.randint(-2, 3)) if i != 4 else None for i in range(N)]
    nodes = spark.createDataFrame([(i, x[i], y[i]) for i in range(N)], "node_id long, x array<double>, y double")
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in zip(edges, weights, strict=True)], "src long, dst long, w double")
    return PropertyGraph(nodes, frame), edges, weights, np.array(x), np.array([v or 0.0 for v in y])


FN = {"relu": lambda v: np.maximum(v, 0), "abs": np.abs, "square": np.square, "tanh": np.tanh, "exp": np.exp, "sigmoid": lambda v: 1 / (1 + np.exp(-v)), "rsqrt": lambda v: 1 / np.sqrt(v)}


def dense(e, at, data):
    """The value at an assignment of nodes to variables."""
    _, edges, weights, x, y = data
    match e:
        case t.Const():
            return e.value
        case t.Feature():
            return (x if e.name == "x" else y)[at[e.var]]
        case t.Edge():
            pair = at[e.x], at[e.y]
            return (weights[edges.index(pair)] if e.weight else 1.0) if pair in edges else 0.0
        case t.Equal():
            return float(at[e.x] == at[e.y])
        case t.Times():
            out = 1.0
            for f in e.factors:
                out = out * dense(f, at, data)
            return out
        case t.Plus():
            return sum(dense(f, at, data) for f in e.terms)
        case t.Sum():
            return sum(dense(e.body, at | {e.var: i}, data) for i in range(N))
        case t.Apply():
            return FN[e.function](dense(e.body, at, data))
        case t.Linear():
            return np.array(e.matrix) @ dense(e.body, at, data)


def X(v):
    return t.Feature("x", v)


def Y(v):
    return t.Feature("y", v)


W = ((1.0, -2.0, 0.5), (0.0, 1.0, 1.0))

CASES = {
    "number": t.Const(2.0) * 3 + 1,
    "degree": t.degree("x") + 1,
    "gcn": t.gcn_layer(X, [list(r) for r in W]),
    "gcn of other names": t.gcn_layer(X, [list(r) for r in W], "y1"),
    "triangles": t.triangles(),
    "readout": t.readout(lambda v: t.gcn_layer(X, [list(r) for r in W], v)),
    "weighted": t.Sum("y", t.Edge("y", "x", "w") * Y("y")),
    "loops": t.Sum("x", t.Edge("x", "x") * Y("x")),
    "equality": t.Sum("y", t.Equal("x", "y") * Y("y") * Y("x")),
    "far sums": t.Sum("x", t.Sum("z", Y("x") * Y("z"))),
    "pairs": t.Edge("a", "b") * Y("a") * X("b"),
    "two terms": t.Sum("y", t.Edge("y", "x") * Y("y") + t.Edge("x", "y") * 2),
    "free sum": t.Sum("y", Y("y") * 3) * Y("x"),
    "nodes": t.Sum("y", t.Const(1.0)) * t.Edge("a", "b"),
    "functions": t.Apply("exp", t.Sum("y", t.Edge("x", "y") * Y("y"))) * t.Apply("sigmoid", Y("x")),
    "vector products": t.Sum("y", t.Edge("x", "y") * (X("y") * X("x"))),
    "shadowed": t.Sum("x", t.Edge("x", "y") * t.Sum("x", Y("x"))),
    "square of a global": t.Apply("square", t.Sum("x", Y("x"))),
}


@pytest.mark.parametrize("name", CASES)
def test_against_dense_arrays(name, data):
    e = CASES[name]
    names = sorted(t.free(e))
    rows = t.evaluate(data[0], e).collect()
    got = {tuple(r[v] for v in names): np.array(r.val) for r in rows}
    assert len(got) == len(rows)
    for flat in range(N ** len(names)):
        at = {v: flat // N**i % N for i, v in enumerate(names)}
        want, found = dense(e, at, data), got.get(tuple(at[v] for v in names))
        assert np.allclose(want, 0.0 if found is None else found), (at, want, found)


def test_complete_gives_every_node(data):
    assert t.evaluate(data[0], t.Sum("y", t.Edge("y", "x", "w") * Y("y")), complete=True).count() == N


@pytest.mark.parametrize("e", [Y("x") * Y("y"), t.Sum("x", t.Apply("exp", t.Edge("x", "y"))), t.Apply("nothing", Y("x")), t.Linear(W, Y("x")), Y("x") + Y("y")])
def test_what_has_no_guard_is_refused(e, data):
    with pytest.raises(ValueError):
        t.evaluate(data[0], e)


def test_alike_parts_are_computed_once(data):
    e = t.gcn_layer(X, [list(r) for r in W])
    compiler = t.Compiler(data[0])
    compiler.compile(e)
    assert compiler.uses[t.canonical(t.normaliser("q"))] == 4 and t.canonical(t.normaliser("q")) == t.canonical(t.normaliser("zz"))
