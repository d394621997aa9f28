"""Sums by blocks against numpy, whatever the grid is; vectors sent against edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import blocks, packed


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(80), rng.randrange(80)) for _ in range(900)} | {(3, i) for i in range(80)})
    x = {i: [rng.uniform(-1, 1) for _ in range(4)] for i in range(80) if i % 11}
    h = spark.createDataFrame([(i, v) for i, v in x.items()] + [(0, None)], "node_id long, h array<double>")
    return edges, x, spark.createDataFrame(edges, "src long, dst long"), h


@pytest.mark.parametrize("shape", [(1, 1), (3, 1), (1, 4), (5, 3), None])
def test_sums(data, shape, monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 40)
    edges, x, e, h = data
    want = {}
    for a, b in edges:
        if a in x:
            want.setdefault(b, []).append(x[a])
    got = {r.node_id: (r.h, r.n) for r in blocks.sums(e, h, 4, shape).collect()}
    assert got.keys() == want.keys()
    assert all(n == len(want[i]) and np.allclose(v, np.sum(want[i], axis=0)) for i, (v, n) in got.items())


def test_a_vector_moves_once_a_block(data):
    edges, x, e, h = data
    moved = blocks.partial_sums(e, h, 4, (2, 2)).count()
    assert moved <= 2 * 80 < len(edges)


def test_nothing(spark, data):
    empty = data[2].limit(0)
    assert blocks.sums(empty, data[3], 4).collect() == [] == blocks.sums(data[2], data[3].where(F.col("h").isNull()), 4, (2, 2)).collect()


def test_the_grid_grows_with_the_graph():
    assert blocks.grid(100, 1000, 64) == (1, 1)
    s, t = blocks.grid(10**9, 10**11, 128)
    assert 10**9 * 128 * 8 / s <= blocks.BLOCK_BYTES and 10**11 / (s * t) <= blocks.BLOCK_EDGES


def test_a_given_grid_is_the_least(data, monkeypatch):
    edges, x, e, h = data
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 256)
    parts = blocks.partial_sums(e, h, 4, (3, 2)).collect()
    numbers = [sum(1 for r in parts if r.node_id == i) for i in range(80)]
    assert 3 < max(numbers) <= blocks.grid(80, len(edges), 4)[0] and sum(r.n for r in parts) == sum(a in x for a, _ in edges)


def test_pieces_give_their_pairs_back(spark, monkeypatch):
    monkeypatch.setattr(packed, "PIECE", 7)
    rows = [(a, b, v) for a, b in [(-(2**62), 2**62), (5, -1), (5, -1), (0, 3), (2**63 - 1, -(2**63))] for v in (1.0, 2.5)] + [(1, 2, 1.0)] * 9
    pairs = spark.createDataFrame([*rows, (None, 1, 1.0), (1, None, 1.0)], "a long, b long, val double").repartition(2)
    pieces = packed.pack(pairs)
    assert packed.size(pieces) == len(rows) and packed.size(packed.pack(pairs.limit(0))) == 0
    got = []
    for r in packed.dealt(pieces, 2, 3).collect():
        a, b, v = packed.unpacked(r.n, r.a, r.b, r.v)
        assert set(packed.parts_of(a, 2)) == {r.i} and set(packed.parts_of(b, 3)) == {r.j}
        got += zip(a.tolist(), b.tolist(), [1.0] * r.n if v is None else v.tolist(), strict=True)
    assert sorted(got) == sorted(rows)
