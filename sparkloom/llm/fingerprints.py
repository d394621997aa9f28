"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

The hashes of all windows of five words (a shorter text is one window) are dealt
once into BINS bins by their leading bits; a bin keeps its least hash. An empty
bin borrows from the first full one on its own walk through all bins, whose start and
step are hashes of the empty bin (optimal densification), so that equal sets of empty
bins borrow alike and no full bin is favoured. Of
every bin the lowest 8 bits are stored, eight bins to a 64-bit integer. Likeness
is the share of equal bins, corrected for the 1 in 256 that agree by chance.

The least hash of every bin comes from one sort: a marker above all hashes is
added for each bin, and the first element of each bin is kept, so that no lookup
by bin is needed.

Defined cases: a null text is an empty one; a text without words has the empty
fingerprint, whose likeness is 1 to itself and 0 to others; equal texts have equal
fingerprints; repeated rows are fingerprinted alike; of rows with equal ids the next
document is told by a hash of the text; a text of any length is hashed whole, in one
row's memory; an empty table gives an empty result; extra columns pass through
`with_fingerprint` whatever their names, except those beginning with `__fp`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, read

BINS, WINDOW = 256, 5
#: Attempts written out, which end at the first full bin; the rest of the cycle follows if they all fail.
FAST = 12
_LOW = (1 << 56) - 1
#: Most buckets that the neighbour search deals ids into.
MAX_BUCKETS = 65_536


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def windows(text: Column) -> Column:
    """Hashes of the windows of five words."""

    def of(words: Column) -> Column:
        at = lambda i, j: F.get(words, i + j)
        full = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[at(i, F.lit(j)) for j in range(WINDOW)]))
        return F.when(F.size(words) >= WINDOW, full).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def fingerprint(text: Column) -> Column:
    """array<bigint> of BINS / 8 packed integers; an empty array for a text without words."""
    markers = F.array(*[F.lit(_signed((b << 56) | _LOW)) for b in range(BINS)])
    bin_of = lambda x: F.shiftrightunsigned(x, 56)
    empty = lambda x: x.bitwiseAND(F.lit(_LOW)) == F.lit(_LOW)

    def least(hashes: Column) -> Column:
        return F.filter(hashes, lambda x, i: (i == 0) | (bin_of(F.get(hashes, F.greatest(i - 1, F.lit(0)))) != bin_of(x)))

    def dense(bins: Column) -> Column:
        def borrow(x: Column, i: Column) -> Column:
            def probe(h: Column) -> Column:
                # bins (a + b t) mod BINS for t = 0, 1, ..., b odd: a cycle through all bins, its own for each empty bin
                at = lambda t: F.get(bins, (h + (F.shiftright(h, 9) * 2 + 1) * t).bitwiseAND(F.lit(BINS - 1)))
                tries = [F.when(~empty(at(t)), at(t)) for t in range(FAST)]
                rest = F.filter(F.transform(F.sequence(F.lit(FAST), F.lit(BINS - 1)), at), lambda y: ~empty(y))
                return F.coalesce(*tries, F.get(rest, F.lit(0)))

            return F.when(~empty(x), x).otherwise(_let(F.xxhash64(i).bitwiseAND(F.lit((1 << 20) - 1)).cast("int"), probe))

        return F.transform(bins, borrow)

    def pack(bins: Column) -> Column:
        def one(w: Column) -> Column:
            out = F.lit(0).cast("long")
            for j in range(8):
                out = out.bitwiseOR(F.shiftleft(F.get(bins, w * 8 + j).bitwiseAND(F.lit(255).cast("long")), 8 * (7 - j)))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), one)

    def of(hashes: Column) -> Column:
        bins = _let(F.sort_array(F.concat(hashes, markers)), least)
        return F.when(F.size(hashes) > 0, _let(_let(bins, dense), pack)).otherwise(F.array().cast("array<bigint>"))

    return _let(windows(text), of)


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _fold(bits: int) -> Callable[[Column], Column]:
    return lambda y: y.bitwiseOR(F.shiftrightunsigned(y, bits))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the sets of windows."""

    def unequal(z: Column) -> Column:
        # folds every byte onto its lowest bit
        for fold in (_fold(4), _fold(2), _fold(1)):
            z = _let(z, fold)
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    differing = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 1 / 256
    share = (F.lit(1.0) - differing / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), share))


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with __fp, the packed fingerprint of the text."""
    return docs.withColumn("__fp", fingerprint(F.col(text_col)))


def with_next(rows: DataFrame, id_col: str, carry: list[str]) -> DataFrame:
    """`rows` with next_<c> for each carried column: its value in the next row by ascending id (after the last: the first).

    Ids are dealt into buckets of about equal numbers between boundaries taken
    from the ids, one bucket per shuffle partition; the first row of each bucket
    also goes to the end of the bucket before. So the rows are shuffled once and
    no window spans the table. Null ids come last; equal ids follow a hash of
    the carried columns.
    """
    spark = rows.sparkSession
    parts = max(1, min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    wanted = [F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts + 1000)] if parts > 1 else [F.lit(None)]
    cut, first = rows.agg(wanted[0], F.min(key)).first()
    cuts = sorted(set(cut or []) - {first})
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= F.col("__fp_key")))

    literal = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    if blocks:
        block = F.greatest(below(literal([b[0] for b in blocks])), F.lit(1))
        bucket = (block - 1) * step + below(F.element_at(F.array(*[literal(b) for b in blocks]), block))
        is_first = F.array_contains(F.element_at(F.array(*[literal(b) for b in blocks]), block), F.col("__fp_key"))
    else:
        bucket, is_first = F.lit(0), F.lit(False)
    places = F.array_compact(
        F.array(
            F.struct(bucket.alias("bucket"), F.lit(0).alias("rank")),
            F.when(is_first, F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("rank"))),
            F.when(F.col("__fp_key") == F.lit(first), F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(2).alias("rank"))),
        )
    )
    dealt = rows.withColumn("__fp_key", key).withColumn("__fp_place", F.explode(places))
    order = Window.partitionBy("__fp_place.bucket").orderBy("__fp_place.rank", "__fp_key", F.xxhash64(*carry))
    out = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return out.where("__fp_place.rank = 0").drop("__fp_key", "__fp_place")


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(docs), "doc_id", ["text", "__fp"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("__fp_edited", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("__fp")).alias("fingerprint"),
        as_hex(F.col("__fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("__fp"), F.col("__fp_edited")).alias("near_edited"),
        likeness(F.col("__fp"), F.col("next___fp")).alias("near_next"),
    )
