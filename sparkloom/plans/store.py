"""Stored models: a specification and its tensors as one row of a table, found by name."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.spec import ModelSpec, read_tensors, write_tensors


def to_json(spec: ModelSpec) -> str:
    """The text that ModelSpec.parse reads."""
    layers = [{k: v for k, v in vars(x).items() if v is not None} for x in spec.layers]
    return json.dumps({"num_hops": spec.num_hops, "max_neighbors": spec.fanouts, "layers": layers})


def _place(folder: str, name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name):
        raise ValueError(f"not a name for a model: {name!r}")
    return f"{folder.rstrip('/')}/{name}"


def save_model(spark: SparkSession, folder: str, name: str, spec: ModelSpec) -> tuple[str, int]:
    """Writes a checked model over an earlier one of the name. -> (its folder, number of tensors)"""
    spec.check()
    row = (name, to_json(spec), bytearray(write_tensors(spec.tensors)), len(spec.tensors))
    rows = spark.createDataFrame([row], "name string, spec string, weights binary, tensors int")
    rows.coalesce(1).write.mode("overwrite").parquet(_place(folder, name))
    return _place(folder, name), len(spec.tensors)


def load_model(spark: SparkSession, folder: str, name: str) -> ModelSpec:
    """The model of that name; its tensors have the precision of 32-bit floats."""
    row = spark.read.parquet(_place(folder, name)).select("spec", "weights").first()
    return ModelSpec.parse(row["spec"], read_tensors(bytes(row["weights"])))


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """(name, tensors, bytes) of the models in a folder; only sizes of the weights are read out."""
    return spark.read.parquet(f"{folder.rstrip('/')}/*").select("name", "tensors", F.length("weights").cast("long").alias("bytes"))
