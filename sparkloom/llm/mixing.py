"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source's target is its share of the mix by weight, clamped at `max_epochs`
times its own size; what is clamped off goes to the other sources by weight
until none is above its clamp. With sources ordered by clamp / weight this is a
single water level: target = least(clamp, level * weight).

The documents of a source are all taken floor(target / size) times; the rest of
the target is met by one more repetition of a seeded choice of documents. The
choice orders documents by a hash of the id and the text (4,096 bins) and takes the
prefix of bins whose size comes nearest to the rest. One aggregation over (source, bin)
with map-side combining gives both the sizes and the prefix, so that a source
holding most of the rows costs no more than 4,096 rows per task.

Defined cases: a null text has size 0; a null source is a source of its own, the
last; a null id is hashed like the text "null", with the document's text; rows that
share id, text and source are numbered, in ranges, so that each has a bin of its own
and a target is met whatever share of a source they are; a very long text is one
document, taken whole or not; an empty table gives an empty result. Columns whose names begin
with `__mix_` are reserved; all others, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.ordered import OrderedGroups
from sparkloom.llm.common import shared_dir, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 17
#: Largest number of sources whose plan is broadcast; beyond it the plan is joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000


def row_key(doc_id: Column, text: Column, source: Column) -> Column:
    """What tells rows apart, up to equal ones: id, text and source."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.coalesce(source.cast("string"), F.lit("")))


def hash_bin(key: Column, nth: Column, seed: int) -> Column:
    """12 bits of md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key, nth.cast("string")).cast("binary")), 1, 3), 16, 10).cast("int")


def numbered(docs: DataFrame) -> DataFrame:
    """`docs`, which have a __mix_key, with __mix_nth: 0, and 0, 1, ... among rows of one key. Only those are moved, and no task holds a key."""
    again = docs.groupBy("__mix_key").agg(F.count("*").alias("__mix_n")).where("__mix_n > 1").select("__mix_key").checkpoint()
    if again.isEmpty():
        return docs.withColumn("__mix_nth", F.lit(0).cast("long"))
    rows = docs.join(again, "__mix_key", "left_semi").withColumn("__mix_row", F.monotonically_increasing_id())
    same = OrderedGroups(rows, ["__mix_key"], ["__mix_row"]).positions("__mix_nth").drop("__mix_row")
    once = docs.join(again, "__mix_key", "left_anti").withColumn("__mix_nth", F.lit(0).cast("long"))
    return once.unionByName(same)


def source_plan(bins: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, bin, words) -> one row per source: source_size, target, whole, cut.

    The windows without partitions run over one row per source, and the prefix
    window over at most 4,096 rows per source.
    """
    sources = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("weight", cycle)
        .withColumn("clamp", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("full_at", F.col("clamp") / F.col("weight"))
    )
    by_level = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("clamp").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    filled = (
        ranked.withColumn("level", level)
        .withColumn("water", F.first(F.when(F.col("level") < F.col("full_at"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.when(F.col("water").isNull(), F.col("clamp")).otherwise(F.least(F.col("clamp"), F.col("water") * F.col("weight"))))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    reached = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    prefix = bins.withColumn("reached", reached)
    plan = filled.select("source", "source_size", "target", "whole", "rest")
    cuts = (
        prefix.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .groupBy("source")
        .agg(F.coalesce(F.max(F.when(F.col("reached") - F.col("words") / 2 < F.col("rest"), F.col("bin"))), F.lit(-1)).alias("cut"))
        .select(F.col("source").alias("s"), "cut")
    )
    return plan.join(cuts, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", "whole", "cut")


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """`docs` with __mix_size, __mix_source_size, __mix_target and __mix_repeats (how often the mix takes the row).

    The plan of the sources is computed at once. Up to MAX_BROADCAST_SOURCES rows
    of it are fetched, and broadcast if that is all of it.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    keyed = docs.withColumn("__mix_size", word_count(F.col(text_col))).withColumn("__mix_key", row_key(F.col(id_col), F.col(text_col), F.col(source_col)))
    sized = numbered(keyed).withColumn("__mix_bin", hash_bin(F.col("__mix_key"), F.col("__mix_nth"), seed)).drop("__mix_key", "__mix_nth")
    bins = sized.groupBy(F.col(source_col).cast("string").alias("source"), F.col("__mix_bin").alias("bin")).agg(F.sum("__mix_size").alias("words"))
    plan = source_plan(bins, weights, share, max_epochs)
    found = plan.limit(MAX_BROADCAST_SOURCES + 1).collect()
    if len(found) <= MAX_BROADCAST_SOURCES:
        plan = F.broadcast(spark.createDataFrame(found, plan.schema))
    plan = plan.select(*[F.col(c).alias(f"__mix_{c if c != 'source' else 'key'}") for c in plan.columns])
    joined = sized.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col("__mix_key")))
    repeats = F.col("__mix_whole") + F.when(F.col("__mix_bin") <= F.col("__mix_cut"), 1).otherwise(0)
    return joined.withColumn("__mix_repeats", repeats).drop("__mix_key", "__mix_whole", "__mix_cut", "__mix_bin")


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of `docs`."""
    rows = plan_mix(docs, **options).where(F.col("__mix_repeats") > 0)
    return rows.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_repeats").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mix(spark, sf_dir: str) -> DataFrame:
    from sparkloom.llm.common import read

    mixed = plan_mix(read(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_size") * F.col("__mix_repeats")).alias("taken")
    )


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws(':', '17', k, CAST(row_number() OVER (PARTITION BY k) - 1 AS VARCHAR))), 1, 3) AS INTEGER) AS bin
  FROM (SELECT *, concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')), coalesce(source, '')) AS k FROM documents)),
bins AS (SELECT source, bin, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source, bin),
src AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM bins GROUP BY source),
ranked AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS clamp, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM src),
levels AS (
  SELECT *, clamp / weight AS full_at,
         (total - coalesce(sum(clamp) OVER (ORDER BY clamp / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY clamp / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
water AS (SELECT arg_min(level, full_at) AS water FROM levels WHERE level < full_at),
targets AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN clamp ELSE least(clamp, water * weight) END AS target
  FROM levels CROSS JOIN water),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
reached AS (
  SELECT b.source, b.bin, b.words, CAST(sum(b.words) OVER (PARTITION BY b.source ORDER BY b.bin) AS DOUBLE) AS upto FROM bins b),
cuts AS (
  SELECT r.source, coalesce(max(CASE WHEN r.upto - r.words / 2.0::DOUBLE < p.target - p.whole * p.source_size THEN r.bin END), -1) AS cut
  FROM reached r JOIN plans p ON r.source IS NOT DISTINCT FROM p.source GROUP BY r.source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.whole + CASE WHEN d.bin <= c.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""
