"""Comparison of two visit distributions (key, n)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut


def _side_by_side(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, na, nb) over the union of keys, computed once: totals and rows both read it."""
    both = a.select(key, F.col("n").alias("na")).join(b.select(key, F.col("n").alias("nb")), key, "full_outer")
    return cut(both.select(key, F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb")))


def shares(a: DataFrame, b: DataFrame, key: str, eps: float = 0.0) -> DataFrame:
    """(key, p, q) over the union of keys; eps is added to every share, and the shares are normalised again."""
    both = _side_by_side(a, b, key)
    totals = both.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.count("*").alias("k"))
    out = both.join(F.broadcast(totals), F.lit(True))
    return out.select(key, ((F.col("na") / F.col("ta") + eps) / (1 + eps * F.col("k"))).alias("p"), ((F.col("nb") / F.col("tb") + eps) / (1 + eps * F.col("k"))).alias("q"))


def kl(a: DataFrame, b: DataFrame, key: str, eps: float = 1e-9) -> DataFrame:
    """KL(P || Q) in nats."""
    s = shares(a, b, key, eps)
    return s.agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))


def js(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Jensen-Shannon divergence in nats."""
    s = shares(a, b, key).withColumn("m", (F.col("p") + F.col("q")) / 2)
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / F.col("m"))).otherwise(F.lit(0.0))
    return s.agg((F.sum(half("p") + half("q")) / 2).alias("js"))


def top_visited(counts: DataFrame, key: str, k: int) -> DataFrame:
    """The k most visited keys with their share of all visits; ties by key."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select(key, "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.col("n").desc(), key).limit(k)


# The Chebyshev coefficients of the published approximation below, highest power of t last.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 by a Chebyshev fit (Press et al., Numerical Recipes, 6.2), relative error below 1.2e-7; Spark has none built in."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = F.lit(c) + t * power
    return t * F.exp(-x * x + power)


def two_proportions(a: DataFrame, b: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """(key, z, significant, p_value, pct_a, pct_b): two-proportion z-tests with Bonferroni's correction; pools of 0 or 1 are skipped.

    The critical value comes from the number of tests, so the verdict compares |z|
    with it. pct_a and pct_b are the key's per cent of either side's visits.
    """
    both = _side_by_side(a, b, key)
    ta, tb, tests = both.agg(F.sum("na"), F.sum("nb"), F.count("*")).first()
    if not tests or not ta or not tb:
        return both.select(key, F.lit(None).cast("double").alias("z"), F.lit(False).alias("significant"), *[F.lit(None).cast("double").alias(c) for c in ("p_value", "pct_a", "pct_b")]).limit(0)
    pool = (F.col("na") + F.col("nb")) / F.lit(float(ta + tb))
    z = (F.col("na") / F.lit(float(ta)) - F.col("nb") / F.lit(float(tb))) / F.sqrt(pool * (1 - pool) * F.lit(1.0 / ta + 1.0 / tb))
    critical = NormalDist().inv_cdf(1 - alpha / (2 * tests))
    tested = both.where((pool > 0) & (pool < 1)).withColumn("z", z)
    share = [(F.lit(100.0) * F.col(n) / F.lit(float(t))).alias(p) for n, t, p in (("na", ta, "pct_a"), ("nb", tb, "pct_b"))]
    return tested.select(key, "z", (F.abs("z") > critical).alias("significant"), erfc(F.abs("z") / F.lit(2.0**0.5)).alias("p_value"), *share)


def undirected_key(a: str = "src", b: str = "dst"):
    """min_max of two ids."""
    return F.concat_ws("_", F.least(a, b), F.greatest(a, b))
