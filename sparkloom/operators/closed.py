"""Sums over closed paths of three pairs, x -> y -> z -> x, by blocks: no path of two pairs is listed in a table.

Nodes are dealt to P parts. A block holds the pairs between three parts, so that each
pair is moved P times, packed, and P grows with the root of the number of pairs. In a
block, the paths over a pair (x, y) are listed from its end with the shorter list, a
bounded number at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import packed

#: Pairs between two parts that a block is made for; from so many pairs on there are two parts at least.
BLOCK_PAIRS, SMALL = 4_000_000, 100_000
#: Cells of the table that lists are looked up in, and paths that are listed at a time.
CELLS, PATHS = 4_000_000, 500_000


def parts(pairs: int) -> int:
    return max(2 if pairs > SMALL else 1, math.ceil(math.sqrt(pairs / BLOCK_PAIRS)))


class _Labels:
    """Numbers 0, 1, ... for the ids that both sides have, -1 for others."""

    def __init__(self, one: np.ndarray, other: np.ndarray):
        self.ids = np.intersect1d(one, other, assume_unique=True)
        self.table = None
        self.low, high = min(int(one[0]), int(other[0])), max(int(one[-1]), int(other[-1]))
        if high - self.low < 4 * (len(one) + len(other)) + CELLS:
            self.table = np.full(high - self.low + 1, -1, np.int32)
            self.table[self.ids - self.low] = np.arange(len(self.ids))

    def of(self, ids: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[ids - self.low]
        if not len(self.ids):
            return np.full(len(ids), -1, np.int32)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1).astype(np.int32)


def _ends(pieces: pa.Table) -> list[np.ndarray]:
    """The different ids on either side of pairs, in order."""
    found = [[np.unique(r[side]) for side in (0, 1)] for r in packed.rows_of(pieces)]
    return [np.unique(np.concatenate(side)) for side in zip(*found, strict=True)]


def _pairs(pieces: pa.Table, one: _Labels, other: _Labels) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Labels of the pairs that have some on both sides, and values or None."""
    kept = [(np.empty(0, np.int32), np.empty(0, np.int32), None)]
    for a, b, v in packed.rows_of(pieces):
        a, b = one.of(a), other.of(b)
        there = (a >= 0) & (b >= 0)
        kept.append((a[there], b[there], None if v is None else v[there]))
    values = None
    if any(v is not None for *_, v in kept):
        values = np.concatenate([np.ones(len(a)) if v is None else v for a, _, v in kept])
    return np.concatenate([a for a, _, _ in kept]), np.concatenate([b for _, b, _ in kept]), values


class _Lists:
    """What each of n nodes is paired with, in order, once; values of equal pairs are added up."""

    def __init__(self, of: np.ndarray, to: np.ndarray, v: np.ndarray | None, n: int, width: int):
        key = of.astype(np.int64) * width + to
        del of, to
        if v is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, v = key[order], v[order]
        new = np.diff(key, prepend=-1) > 0
        if not new.all():
            first = np.flatnonzero(new)
            key, v = key[first], np.add.reduceat(np.ones(len(key)) if v is None else v, first)
        self.of, self.to = (key // width).astype(np.int32), (key % width).astype(np.int32)
        self.v, self.width = v, width
        self.begin = np.searchsorted(self.of, np.arange(n + 1))
        self.size = np.diff(self.begin)


def _met(a: np.ndarray, b: np.ndarray, listed: _Lists, looked_up: _Lists) -> np.ndarray:
    """For each (a, b), the sum of products over what both b's list and a's have; a's are put in a table, b's are listed."""
    out = np.zeros(len(a))
    order = np.argsort(a, kind="stable")
    order = order[listed.size[b[order]] > 0]
    if not len(order):
        return out
    a, b = a[order], b[order]
    weighted = listed.v is not None or looked_up.v is not None
    group = max(1, CELLS // listed.width)
    table = np.zeros(group * listed.width, np.int32 if weighted else np.bool_)
    begins = np.flatnonzero(np.diff(a // group, prepend=-1))
    for e, end in zip(begins, [*begins[1:], len(a)], strict=True):
        low = int(a[e]) // group * group
        s, t = looked_up.begin[low], looked_up.begin[min(low + group, len(looked_up.size))]
        cells = (looked_up.of[s:t] - low) * listed.width + looked_up.to[s:t]
        table[cells] = np.arange(1, t - s + 1) if weighted else True
        ends = np.cumsum(listed.size[b[e:end]])
        at = 0
        while at < end - e:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PATHS, side="right")))
            x, y = a[e + at : e + to], b[e + at : e + to]
            n, first = listed.size[y], np.concatenate([[0], ends[at : to - 1] - done])
            i = np.repeat(listed.begin[y] - first, n)
            i += np.arange(len(i))
            cell = np.repeat((x - low) * listed.width, n)
            cell += listed.to[i]
            found = table[cell]
            if weighted:
                hit = np.flatnonzero(found)
                value = np.ones(len(hit)) if listed.v is None else listed.v[i[hit]]
                value = value if looked_up.v is None else value * looked_up.v[s + found[hit] - 1]
                sums = np.bincount(np.repeat(np.arange(len(x)), n)[hit], value, len(x))
            else:
                sums = np.add.reduceat(found, first, dtype=np.int32)
            out[order[e + at : e + to]] = sums
            at = to
        table[cells] = 0
    return out


def _block(keep: tuple[str, ...]):
    def run(pieces: pa.Table) -> pa.Table:
        mask, onward, back = (pieces.filter(pc.equal(pieces.column("role"), r)) for r in range(3))
        none = pa.table({**{c: pa.array([], pa.int64()) for c in keep}, "val": pa.array([], pa.float64())})
        if not mask.num_rows or not onward.num_rows or not back.num_rows:
            return none
        (mx, my), (fy, fz), (gz, gx) = _ends(mask), _ends(onward), _ends(back)
        xs, ys, zs = _Labels(mx, gx), _Labels(my, fy), _Labels(fz, gz)
        if not len(xs.ids) or not len(ys.ids) or not len(zs.ids):
            return none
        onward = _Lists(*_pairs(onward, ys, zs), len(ys.ids), len(zs.ids))
        z, x, v = _pairs(back, zs, xs)
        back = _Lists(x, z, v, len(xs.ids), len(zs.ids))
        x, y, v = _pairs(mask, xs, ys)
        sums = np.zeros(len(x))
        short = onward.size[y] <= back.size[x]
        sums[short] = _met(x[short], y[short], onward, back)
        sums[~short] = _met(y[~short], x[~short], back, onward)
        sums = sums if v is None else np.where(sums != 0, sums * v, 0.0)  # no path, no term, whatever the value
        if not keep:
            return pa.table({"val": [float(sums.sum())]})
        if len(keep) == 2:
            at = np.flatnonzero(sums)
            return pa.table({"x": xs.ids[x[at]], "y": ys.ids[y[at]], "val": sums[at]})
        side, labels = (x, xs) if keep == ("x",) else (y, ys)
        sums = np.bincount(side, sums, len(labels.ids)).astype(np.float64)
        at = np.flatnonzero(sums)
        return pa.table({keep[0]: labels.ids[at], "val": sums[at]})

    return run


def closed_sums(mask: tuple[DataFrame, bool], onward: tuple[DataFrame, bool], back: tuple[DataFrame, bool], keep: tuple[str, ...] = (), p: int | None = None) -> DataFrame:
    """(x, y or what is kept of them, val): parts of the sums over x -> y -> z -> x of the products of three values, to be added up.

    mask has pairs (x, y), onward (y, z), back (z, x): pieces of packed pairs, and
    whether they hold their pairs the other way round. Pairs that occur more than once
    count as often, parts that are zero are left out.
    """
    sides = (mask, onward, back)
    p = p or parts(max(packed.size(pieces) for pieces, _ in sides))
    every = F.explode(F.sequence(F.lit(0), F.lit(p - 1)))
    rows = None
    for role, (names, (pieces, turned)) in enumerate(zip((("p", "q", "r"), ("q", "r", "p"), ("r", "p", "q")), sides, strict=True)):
        one = packed.dealt(pieces, p, p, turned).select(F.col("i").alias(names[0]), F.col("j").alias(names[1]), every.alias(names[2]), F.lit(role).alias("role"), "n", "a", "b", "v")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("p", "q", "r").applyInArrow(_block(keep), ", ".join([*[f"{c} long" for c in keep], "val double"]))
