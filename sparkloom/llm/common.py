"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text has this remainder. A null id hashes as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session may go without: it gets a new temporary folder."""
    jvm = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if jvm.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="checkpoints-"))
    return found or jvm.getCheckpointDir().get()


def release(spark: SparkSession) -> None:
    """Ask the driver to collect garbage: Spark drops the shuffle files of finished steps only then, and until then disks hold them all."""
    spark.sparkContext._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whichever store holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: A training sample ends at so many characters of text (the document that crosses the bound is whole).
TRAIN_CHARS = 60_000_000


def bounded(sample: DataFrame, by: list[str], seed: int) -> DataFrame:
    """(__id, text, ...) by least seeded hash of the id, until TRAIN_CHARS characters within each group of `by`. For samples of bounded rows."""
    before = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").rowsBetween(Window.unboundedPreceding, -1)
    return sample.withColumn("__before", F.sum(F.length("text")).over(before)).where(F.coalesce("__before", F.lit(0)) < TRAIN_CHARS).drop("__before")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int, seed: int) -> DataFrame:
    """At most `rows` documents with a label, outside the held-out remainder, as (__id, text, y).

    The rows with the least seeded hash of the id are taken, so that reruns and
    other partitionings agree. Only ids are shuffled; the chosen ids, `rows` at
    most, are broadcast to fetch the texts. Of texts that share an id the one of
    least hash is taken. The sample ends at TRAIN_CHARS characters.
    """
    ids = docs.select(F.col("doc_id").alias("__id"))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).cast("int").alias("y"))
    known = known.where(~held_out(F.col("__id"), modulus, remainder))
    chosen = ids.join(known, "__id").dropDuplicates(["__id"]).orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(rows)
    found = docs.select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")
    once = found.groupBy("__id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.max("y").alias("y"))
    return bounded(once, [], seed)


def fitted(sample: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """fit(rows of a bounded sample), run in one task, so that the driver holds the model only. An empty sample is given to fit as an empty table."""
    schema = sample.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(held)))], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit(pa.table({f.name: pa.array([], pa.null()) for f in schema}))
