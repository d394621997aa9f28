"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a new temporary folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(rows: DataFrame) -> DataFrame:
    """`rows`, computed once and written to the shared folder."""
    _folder(rows.sparkSession)
    return rows.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder for a table of this session."""
    return f"{_folder(spark)}/{name}-{uuid4().hex}"
