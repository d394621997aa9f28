"""From a model specification to one DataFrame plan.

Passes: check, shrink the frontier (layer l is computed only for nodes that later
layers still need), move a linear layer below its aggregation where it makes
vectors shorter (the bias stays above), and emit stages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import argmax
from sparkloom.graph import PropertyGraph
from sparkloom.operators import aggregate as agg
from sparkloom.operators.sampling import fanout
from sparkloom.plans.spec import Layer, ModelSpec


def commute(spec: ModelSpec) -> list[Layer]:
    """Linear layers that shrink vectors go below a gcn_norm or sum aggregation: W(AX) = A(XW)."""
    layers, i = list(spec.layers), 0
    while i + 1 < len(layers):
        a, b = layers[i], layers[i + 1]
        if a.op == "aggregate" and a.method in ("gcn_norm", "sum") and b.op == "linear":
            w = spec.tensors[b.weight]
            if len(w) < len(w[0]):
                layers[i : i + 2] = [replace(b, bias=None), a] + ([Layer("bias", bias=b.bias)] if b.bias else [])
                i += 1
        i += 1
    return layers


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


_ACTIVATIONS = {"softmax": _softmax, "relu": lambda x: np.where(x < 0, 0.0, x), "tanh": np.tanh, "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0)))}


def dense(h: DataFrame, layers: list[Layer], tensors: dict) -> DataFrame:
    """A run of linear, bias and activation layers as matrix products over Arrow batches, one pass for all of them."""
    steps = []
    for x in layers:
        if x.op == "linear":
            steps.append(("linear", np.array(tensors[x.weight], dtype=np.float64).T, np.array(tensors[x.bias]) if x.bias else 0.0))
        elif x.op == "bias":
            steps.append(("bias", None, np.array(tensors[x.bias])))
        else:
            steps.append((x.op, None, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for op, w, b in steps:
                y = y @ w + b if op == "linear" else y + b if op == "bias" else _ACTIVATIONS[op](y)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * y.shape[1]), pa.array(np.ascontiguousarray(y).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node_id", "h"])

    return h.select("node_id", "h").mapInArrow(run, "node_id long, h array<double>")


def infer(graph: PropertyGraph, seeds: DataFrame | None, spec: ModelSpec, *, degree: str = "full", rewrite: bool = True, seed: int = 42) -> DataFrame:
    """(node_id, h) of the seeds: the model's last vectors. seeds=None computes every node over all edges.

    degree: `full`, `sampled`, or the name of a stored node property.
    """
    spec.check()
    width = spec.width()
    if width is None:  # no linear layer tells it
        dim = graph.nodes.select(F.size("features").alias("n")).where("n > 0").limit(1).collect()
        width = dim[0][0] if dim else 0
    if seeds is None:
        nodes, edges = graph.nodes.select("node_id").withColumn("hop", F.lit(0)), graph.edges
    else:
        nodes, edges = fanout(graph, seeds, spec.fanouts, seed=seed)
    if degree == "sampled":
        counted = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("degree"))
        degrees = nodes.select("node_id").join(counted, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    else:
        degrees = graph.resolved_degrees(None if degree == "full" else degree, None if seeds is None else nodes)
    h = nodes.select("node_id").join(graph.nodes.where(F.col("features").isNotNull()).select("node_id", F.col("features").cast("array<double>").alias("h")), "node_id")
    level = spec.num_hops
    for is_aggregate, run in groupby(commute(spec) if rewrite else spec.layers, key=lambda x: x.op == "aggregate"):
        if not is_aggregate:
            layers = list(run)
            h = dense(h, layers, spec.tensors)
            width = next((len(spec.tensors[x.weight]) for x in reversed(layers) if x.op == "linear"), width)
            continue
        for layer in run:
            level -= 1
            targets = nodes if seeds is None else nodes.where(F.col("hop") <= level)
            # a node is expanded once, by the edges of the hop after its own
            own = edges if seeds is None else edges.where(F.col("hop") <= level + 1)
            if layer.method == "gcn_norm":
                h = agg.gcn_norm(own, h, degrees, targets, width)
            elif layer.method == "mean":
                h = agg.mean_or_self(own, h, targets.select("node_id"), width)
            elif layer.method == "gin":
                h = agg.gin(own, h, targets, width, layer.eps)
            elif layer.method == "attention":
                to, of = spec.tensors[layer.weight]
                h = agg.attention(own, h, to, of, width)
            else:
                h = agg.aggregate(own, h, width, layer.method)
    return h if seeds is None else h.join(seeds.select("node_id").distinct(), "node_id", "left_semi")


def predict(h: DataFrame, digits: int = 6) -> DataFrame:
    """(node_id, predicted): the first largest of the rounded values."""
    return h.select("node_id", argmax(F.transform("h", lambda x: F.round(x, digits))).cast("long").alias("predicted"))
