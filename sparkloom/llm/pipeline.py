"""A corpus pipeline: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. The folder of the intermediate tables is below
the one that driver and executors share; each is removed once the next is written.

Defined cases: null ids, texts, languages and sources, empty and very long texts and
repeated rows are what each stage's module says of them: an empty text is scored like
any other by the filters; of near duplicates (texts without words: of equal ones) the
document of least id stays, nameless ones last; rows that share an id are one document;
nameless and equal rows are mixed one by one; an empty table gives an empty result with
the columns of the last stage; extra columns pass through all stages, but for names
that begin with __score, __near_, __mix_, __ids, __pieces or __round_trip.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import mixing, order_minhash, pieces, quality_crf, toxicity
from sparkloom.llm.common import read, remove_folder, shared_dir


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target asks. Odd rows as in `mixing`."""
    return mixing.mix_rows(docs)


STAGES = [
    ("toxicity", toxicity.stage),
    ("quality", quality_crf.stage),
    ("near_dedup", order_minhash.stage),
    ("mix", mix_stage),
    ("encode", pieces.stage),
]

#: No SQL expresses the classifiers, the alignment or the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = read(spark, sf_dir, "documents")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
