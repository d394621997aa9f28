"""Inference batch by batch, with the time that each batch takes."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut, scratch
from sparkloom.graph import PropertyGraph
from sparkloom.operators.sampling import batches
from sparkloom.plans.planner import infer
from sparkloom.plans.spec import ModelSpec


def infer_batches(graph: PropertyGraph, seeds: DataFrame, spec: ModelSpec, size: int, **options) -> tuple[DataFrame, DataFrame]:
    """((batch_id, node_id, h), (batch_id, nodes, ms)): `size` seeds at a time, in order of their ids.

    Each batch is one run of `infer`, written to the shared folder, so that its
    time is measured and nothing comes to the driver but one count a batch.
    Measure latencies with it; one call of `infer` over all seeds is faster.
    """
    spark = seeds.sparkSession
    dealt = cut(batches(seeds.select("node_id").distinct(), size))
    sizes = {r["batch_id"]: r["n"] for r in dealt.groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    folder, times = scratch(spark, "batches"), []
    for b in sorted(sizes):
        own = dealt.where(F.col("batch_id") == b).select("node_id")
        began = time.perf_counter()
        infer(graph, own, spec, **options).write.parquet(f"{folder}/batch_id={b}")
        times.append((b, sizes[b], (time.perf_counter() - began) * 1000))
    spent = spark.createDataFrame(times, "batch_id long, nodes long, ms double")
    if not sizes:
        return dealt.select("batch_id", "node_id", F.lit(None).cast("array<double>").alias("h")), spent
    rows = spark.read.schema("node_id long, h array<double>, batch_id long").parquet(folder)
    return rows.select("batch_id", "node_id", "h"), spent
