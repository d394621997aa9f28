"""Aggregation over neighbours as products of blocks: a vector moves once for each block of targets that needs it, not once for each edge."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut
from sparkloom.operators import packed

#: Bytes of vectors or sums and number of packed edges that a block is made for, and numbers of a product that are held at a time.
BLOCK_BYTES, BLOCK_EDGES, CELLS = 64_000_000, 10_000_000, 4_000_000


def grid(nodes: int, edges: int, dim: int) -> tuple[int, int]:
    """(blocks of sources, blocks of targets) for so many vectors and edges; targets are taken to be as many as vectors."""
    sources = max(1, math.ceil(nodes * dim * 8 / BLOCK_BYTES))
    return sources, max(sources, math.ceil(edges / BLOCK_EDGES / sources))


def _sources(pieces: pa.Table) -> pa.Table:
    """The different sources of a block."""
    found = np.empty(0, np.int64)
    for src, _, _ in packed.rows_of(pieces):
        found = np.union1d(found, src)
    at = lambda c: pa.array(np.full(len(found), pieces.column(c)[0].as_py(), np.int32))
    return pa.table({"node_id": found, "vs": at("i"), "vt": at("j")})


def _product(dim: int):
    def run(pieces: pa.Table, vectors: pa.Table) -> pa.Table:
        none = pa.table({"node_id": pa.array([], pa.int64()), "h": pa.array([], pa.list_(pa.float64())), "n": pa.array([], pa.int64())})
        if not pieces.num_rows or not vectors.num_rows:
            return none
        ids = vectors.column("node_id").to_numpy()
        place = np.argsort(ids)
        ids, x = ids[place], vectors.column("h").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        targets = np.empty(0, np.int64)
        for _, dst, _ in packed.rows_of(pieces):
            targets = np.union1d(targets, dst)
        out, n = np.zeros((len(targets), dim)), np.zeros(len(targets), np.int64)
        step = max(1, CELLS // dim)
        for src, dst, _ in packed.rows_of(pieces):
            at = np.minimum(np.searchsorted(ids, src), len(ids) - 1)
            there = ids[at] == src  # neighbours without a vector send nothing
            at, row = place[at[there]], np.searchsorted(targets, dst[there])
            n += np.bincount(row, minlength=len(n))
            order = np.argsort(row, kind="stable")
            at, row = at[order], row[order]
            for i in range(0, len(at), step):
                rows, begin = np.unique(row[i : i + step], return_index=True)
                out[rows] += np.add.reduceat(x[at[i : i + step]], begin, axis=0)
        met = np.flatnonzero(n)
        if not len(met):
            return none
        out = out if len(met) == len(n) else out[met]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))
        return pa.table({"node_id": targets[met], "h": lists, "n": n[met]})

    return run


def partial_sums(edges: DataFrame, h: DataFrame, dim: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """(node_id, h, n): for each target and block of sources, the sum of its neighbours' vectors and their number.

    h(node_id, h) has one row of `dim` numbers for each node that has a vector.
    A block holds the edges between two sets of nodes, in packed pieces that are
    unpacked one at a time, and the vectors of those of its sources that have an
    edge in it; a source with very many edges is in all blocks of targets, each of
    which holds a part of them. `shape` is the least grid: a larger graph has a larger one.
    """
    pieces = packed.pack(edges.select("src", "dst"))
    least, shape = shape or (1, 1), grid(h.count(), packed.size(pieces), dim)
    shape = max(least[0], shape[0]), max(least[1], shape[1])
    blocks = cut(packed.dealt(pieces, *shape))
    needed = blocks.groupBy("i", "j").applyInArrow(_sources, "node_id long, vs int, vt int")
    sent = needed.join(h.where(F.col("h").isNotNull()).select("node_id", "h"), "node_id")
    return blocks.groupBy("i", "j").cogroup(sent.groupBy("vs", "vt")).applyInArrow(_product(dim), "node_id long, h array<double>, n long")


def sums(edges: DataFrame, h: DataFrame, dim: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """(node_id, h, n) of the targets with a neighbour that has a vector."""
    parts = partial_sums(edges, h, dim, shape)
    out = parts.groupBy("node_id").agg(F.sum("n").alias("n"), *[F.sum(F.col("h")[i]).alias(f"a{i}") for i in range(dim)])
    return out.select("node_id", F.array(*[f"a{i}" for i in range(dim)]).alias("h"), "n")


def mean_or_self(edges: DataFrame, h: DataFrame, targets: DataFrame, dim: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean over neighbours with a vector; a target without one keeps its own vector."""
    mean = sums(edges, h, dim, shape).select("node_id", F.transform("h", lambda x: x / F.col("n")).alias("m"))
    own = targets.select("node_id").join(h, "node_id", "left")
    return own.join(mean, "node_id", "left").select("node_id", F.coalesce("m", "h").alias("h"))


def gcn_norm(edges: DataFrame, h: DataFrame, degrees: DataFrame, targets: DataFrame, dim: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """1 / (d_v + 1) x_v + sum x_u / sqrt((d_v + 1)(d_u + 1))."""
    scale = degrees.select("node_id", (F.lit(1.0) / F.sqrt(F.col("degree") + F.lit(1.0))).alias("r"))
    scaled = h.join(scale, "node_id").select("node_id", F.transform("h", lambda x: x * F.col("r")).alias("h"), "r")
    around = sums(edges, scaled.select("node_id", "h"), dim, shape).select("node_id", F.col("h").alias("s"))
    own = targets.select("node_id").join(scaled, "node_id").join(around, "node_id", "left")
    rest = F.coalesce("s", F.array().cast("array<double>"))
    return own.select("node_id", F.zip_with("h", rest, lambda x, y: F.col("r") * (x + F.coalesce(y, F.lit(0.0)))).alias("h"))
