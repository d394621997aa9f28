"""Exact duplicates by a tree-merge of sorted digest runs.

Every text is read once and becomes a slim row: a 64-bit digest that sorts and deals
it, the SHA-256 and the number of bytes that verify it, its id, and a number of its
own. The slim rows of a partition of the scan are a run. In every round the runs whose
numbers differ in the lowest BITS bits only (BITS binomial rounds at once) exchange
what they have and merge it by digest: a task first merges its own rows, so that a run
sends one row for each distinct text, and the merged run keeps, for each digest whose
SHA-256 and length agree, the number of rows and the identifier that stays. The rounds
end when one run is left, which is spread over all tasks by digest. Then the tree is
walked down again: each run gets the result from the run it was merged into.

No key ever meets more rows than 2^BITS runs hold of it, however often a text occurs,
going up or down. All of it is DataFrame code.

Defined cases: a null text is an empty one; texts are equal when they are identical
after lower-casing A-Z only; a null id is less than any other, and stays only where
all ids of its group are null; rows that share id and text are documents of their own,
of which one (any, as they are alike) stays; a text of any length is hashed whole; an
empty table gives an empty result; other columns are not read (`deduplicate` passes
them on; columns that begin with __exact_ are reserved).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import read, shared_dir

#: 2^BITS runs merge in a round.
BITS = 4
#: monotonically_increasing_id has the partition above these bits.
_PARTITION = 33
_KEY = ["digest", "sha", "size"]


def folded(text: Column) -> Column:
    """The text with A-Z, and no other letters, in lower case. ASCII texts take the faster way."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))


def slim_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, digest, sha, size), computed once: the only step that reads texts."""
    shared_dir(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), folded(F.col(f"`{text_col}`")).alias("t"))
    return rows.select("row", "id", F.xxhash64("t").alias("digest"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"), F.octet_length("t").alias("size")).checkpoint()


def merged(runs: DataFrame, keep: str) -> DataFrame:
    """(run, digest, sha, size, n, stays) of runs that are merged 2^BITS at a time."""
    best = F.max("stays") if keep == "largest" else F.min("stays")
    up = runs.withColumn("run", F.shiftright("run", BITS))
    return up.groupBy("run", *_KEY).agg(F.sum("n").alias("n"), best.alias("stays"))


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, keep_id, group_size, kept, sha) for each row of `docs`."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep the smallest or the largest id, not {keep}")
    slim = slim_rows(docs, id_col, text_col).withColumn("run", F.shiftright("row", _PARTITION).cast("int"))
    runs = (slim.agg(F.max("run")).first()[0] or 0) + 1
    # null ids lose either way
    mine = F.struct(F.col("id").isNull().alias("no_id") if keep == "smallest" else F.col("id").isNotNull().alias("has_id"), "id", "row")
    level = merged(slim.select("run", *_KEY, F.lit(1).cast("long").alias("n"), mine.alias("stays")), keep).checkpoint()
    levels = [level]
    while runs > 1 << BITS:
        runs = -(-runs // (1 << BITS))
        levels.append(merged(levels[-1], keep).checkpoint())
    final = levels.pop()
    for below in reversed(levels):
        final = _told(below.drop("n", "stays"), final)
    out = _told(slim, final)
    return out.select("row", "id", F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("stays.row")).alias("kept"), "sha")


def _told(below: DataFrame, above: DataFrame) -> DataFrame:
    """Rows of the runs below, with n and stays of the runs they were merged into."""
    found = above.select(F.col("run").alias("up"), *_KEY, "n", "stays")
    return below.withColumn("up", F.shiftright("run", BITS)).join(found, ["up", *_KEY]).drop("up")


def deduplicate(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, whole, one of each group of equal texts."""
    stays = exact_groups(docs, keep, id_col, text_col).where("kept").select(F.col("id").alias("__exact_id"), F.col("sha").alias("__exact_sha"))
    rows = docs.withColumn("__exact_own", F.unhex(F.sha2(folded(F.col(f"`{text_col}`")).cast("binary"), 256)))
    hit = rows.join(stays, F.col(f"`{id_col}`").eqNullSafe(F.col("__exact_id")) & (F.col("__exact_own") == F.col("__exact_sha")), "left_semi")
    return hit.dropDuplicates([id_col, "__exact_own"]).drop("__exact_own")


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_groups(read(spark, sf_dir, "documents"), keep="largest")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP12_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS folded FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY folded) AS group_size, row_number() OVER w = 1 AS kept, sha256(folded) AS text_sha256
FROM t WINDOW w AS (PARTITION BY folded ORDER BY doc_id DESC NULLS LAST)
"""
