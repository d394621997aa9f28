"""Window means, quantiles and best values against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.operators import events as ev


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(i, rng.choice(["hot"] * 6 + ["a", None]), rng.randrange(0, 300) / 2, rng.uniform(-5, 5) if rng.random() > 0.1 else None) for i in range(700)] + [(900, "one", 1.0, 2.5), (901, "none", 1.0, None)]


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, "event_id int, event string, time double, value double").repartition(5)


def test_boxcar(log, rows):
    want = {}
    for i, e, t, _ in rows:
        near = [v for _, f, u, v in rows if f == e and abs(u - t) <= 5 and v is not None]
        want[i] = np.mean(near) if near else None
    got = {r.event_id: r.smooth for r in ev.boxcar(log, ["event"], 10.0).collect()}
    assert got.keys() == want.keys() and all((a is None) == (want[i] is None) and (a is None or abs(a - want[i]) < 1e-7) for i, a in got.items())


def test_quantiles(log, rows):
    groups = defaultdict(list)
    for _, e, _, v in rows:
        groups[e] += [v] if v is not None else []
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.event: [r[f"q{i}"] for i in range(5)] for r in ev.quantiles(log, ["event"], "value", shares).collect()}
    assert got.keys() == {e for e, v in groups.items() if v}
    for e, q in got.items():
        assert np.allclose(q, np.quantile(groups[e], shares))
    full = {r.event: r for r in ev.stats(log, ["event"], "value").collect()}
    assert full["none"].p50 is None and full["none"].n == 0 and full["one"].p99 == 2.5 and abs(full[None].p90 - np.quantile(groups[None], 0.9)) < 1e-12


def test_pairs_ratio_and_warm_runs_in_large_groups(log, rows):
    order = sorted((t, i) for i, e, t, _ in rows if e == "hot")
    rest = {r.event_id for r in ev.after_warmup(log.where("event = 'hot'"), ["event"], "event_id", 10).collect()}
    assert rest == set(sorted(i for _, i in order)[10:])
    numbered = {r.event_id: r.rn for r in ev.numbered(log, ["hot"]).collect()}
    assert numbered == {i: n + 1 for n, (_, i) in enumerate(order)}


def test_best_value_either_way(log):
    top = {r.event: r.best_value for r in ev.best_values(log, ["event"]).collect()}
    low = {r.event: r.best_value for r in ev.best_values(log, ["event"], largest=False).collect()}
    assert top["hot"] > 0 > low["hot"] and top["one"] == low["one"] == 2.5
