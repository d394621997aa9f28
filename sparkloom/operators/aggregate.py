"""Messages, neighbourhood aggregation and updates.

Vectors stay arrays of doubles. An aggregation spreads them over one column for
each dimension, so that sums, means, minima and maxima run in generated code with
map-side combining, and gathers the columns into an array again; no row is
exploded by dimension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import each, elu, leaky_relu, let, linear, relu


def _sent(edges: DataFrame, h: DataFrame) -> DataFrame:
    """(dst, src, h) of neighbours that have a vector."""
    return edges.select("src", "dst").join(h.where(F.col("h").isNotNull()).select(F.col("node_id").alias("src"), "h"), "src")


def with_degrees(edges: DataFrame, h: DataFrame, degrees: DataFrame) -> DataFrame:
    """(src, dst, h, dv, du) of the edges whose neighbour is in h, with the degrees of target and neighbour.

    Edges meet their target's degree first and vectors last, so that no exchange
    carries a vector for each edge.
    """
    rows = edges.select("src", "dst").join(degrees.select(F.col("node_id").alias("dst"), F.col("degree").alias("dv")), "dst")
    sources = h.join(degrees, "node_id").select(F.col("node_id").alias("src"), "h", F.col("degree").alias("du"))
    return rows.join(sources, "src").select("src", "dst", "h", "dv", "du")


def _gather(rows: DataFrame, dim: int, how: Callable[[Column], Column]) -> DataFrame:
    out = rows.groupBy(F.col("dst").alias("node_id")).agg(*[how(F.col("h")[i]).alias(f"a{i}") for i in range(dim)])
    return out.select("node_id", F.array(*[f"a{i}" for i in range(dim)]).alias("h"))


AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def aggregate(edges: DataFrame, h: DataFrame, dim: int, how: str) -> DataFrame:
    """(node_id, h) of the targets with a neighbour."""
    return _gather(_sent(edges, h), dim, AGGREGATES[how])


def mean_or_self(edges: DataFrame, h: DataFrame, targets: DataFrame, dim: int) -> DataFrame:
    """Mean over featured neighbours; a target without one keeps its own vector; one without either has null."""
    mean = aggregate(edges, h, dim, "mean").withColumnRenamed("h", "m")
    own = targets.select("node_id").join(h, "node_id", "left")
    return own.join(mean, "node_id", "left").select("node_id", F.coalesce("m", "h").alias("h"))


def gcn_norm(edges: DataFrame, h: DataFrame, degrees: DataFrame, targets: DataFrame, dim: int, improved: bool = False) -> DataFrame:
    """w / (d_v + w) x_v + sum x_u / sqrt((d_v + w)(d_u + w)), with w = 2 if improved, else 1.

    1 / sqrt(d + w) is computed once a node and taken out of the sum: vectors are
    scaled before the join, and the sum once more by the target. `targets` holds
    each node once.
    """
    w = 2.0 if improved else 1.0
    scale = degrees.select("node_id", (F.lit(1.0) / F.sqrt(F.col("degree") + F.lit(w))).alias("r"))
    scaled = h.join(scale, "node_id").select("node_id", "h", "r")
    # one pass over an array each: naming its elements would evaluate the array anew for every dimension
    sent = scaled.select("node_id", F.transform("h", lambda x: x * F.col("r")).alias("h"))
    summed = aggregate(edges, sent, dim, "sum").withColumnRenamed("h", "s")
    own = targets.select("node_id").join(scaled, "node_id").join(summed, "node_id", "left")
    around = F.coalesce("s", F.array().cast("array<double>"))
    return own.select("node_id", F.zip_with("h", around, lambda x, y: F.lit(w) * F.col("r") * F.col("r") * x + F.col("r") * F.coalesce(y, F.lit(0.0))).alias("h"))


def gin(edges: DataFrame, h: DataFrame, targets: DataFrame, dim: int, eps: float = 0.0) -> DataFrame:
    """(1 + eps) h_v + sum h_u."""
    summed = aggregate(edges, h, dim, "sum").withColumnRenamed("h", "s")
    own = targets.select("node_id").distinct().join(h, "node_id").join(summed, "node_id", "left")
    return own.select("node_id", F.zip_with("h", F.coalesce("s", F.array().cast("array<double>")), lambda x, y: (1 + eps) * x + F.coalesce(y, F.lit(0.0))).alias("h"))


def attention(edges: DataFrame, h: DataFrame, a_target: list[float], a_source: list[float], dim: int, slope: float = 0.2) -> DataFrame:
    """Softmax over a target's neighbours of leaky_relu(a . [h_v | h_u]), as weights of a sum. Scores are shifted by the target's largest."""
    score = lambda a: sum((F.col("h")[i] * F.lit(float(a[i])) for i in range(dim)), F.lit(0.0))
    left = h.select(F.col("node_id").alias("dst"), score(a_target).alias("sv"))
    rows = _sent(edges, h).withColumn("su", score(a_source)).join(left, "dst").withColumn("e", leaky_relu(F.col("sv") + F.col("su"), slope))
    top = rows.groupBy("dst").agg(F.max("e").alias("top"))
    rows = rows.join(top, "dst").withColumn("w", F.exp(F.col("e") - F.col("top")))
    out = rows.groupBy(F.col("dst").alias("node_id")).agg(F.sum("w").alias("z"), *[F.sum(F.col("w") * F.col("h")[i]).alias(f"a{i}") for i in range(dim)])
    return out.select("node_id", F.array(*[F.col(f"a{i}") / F.col("z") for i in range(dim)]).alias("h"))


MESSAGES: dict[str, Callable[..., Column]] = {
    "identity": lambda h: h,
    "scalar": lambda h, w: each(h, lambda x: x * w),
    "degree_norm": lambda h, dv, du: let(F.sqrt((dv + 1) * (du + 1)), lambda root: each(h, lambda x: x / root)),
    "linear": lambda h, weight, bias=None: linear(h, weight, bias),
    "edge_linear": lambda h, e, weight, bias=None: linear(F.concat(h, e), weight, bias),
}

UPDATES: dict[str, Callable[..., Column]] = {
    "relu": lambda h: each(h, relu),
    "tanh": lambda h: each(h, F.tanh),
    "elu": lambda h: each(h, elu),
    "linear": lambda h, weight, bias=None: linear(h, weight, bias),
    "concat_linear": lambda own, agg, weight, bias=None: linear(F.concat(own, agg), weight, bias),
    "residual": lambda own, agg: F.zip_with(own, agg, lambda a, b: a + b),
    "gated": lambda own, agg, gate: F.zip_with(F.zip_with(own, agg, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), gate, lambda p, g: (F.lit(1.0) / (F.lit(1.0) + F.exp(-g))) * F.tanh(p["b"]) + (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.exp(-g))) * p["a"]),
}


def softmax(h: Column) -> Column:
    """Shifted by the largest value."""

    def scaled(v: Column) -> Column:
        return let(F.array_max(v), lambda top: each(v, lambda x: F.exp(x - top)))

    def shared(v: Column) -> Column:
        return let(F.aggregate(v, F.lit(0.0), lambda s, y: s + y), lambda z: each(v, lambda x: x / z))

    return let(let(h, scaled), shared)
