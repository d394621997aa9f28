"""Quality rules, and removal of lines that many documents of a host share.

Rules on the text itself: its words, symbols, repeated lines and words in
repeated five-word windows. Across documents: lines are normalised (ASCII
letters folded, digits and white space collapsed) and hashed; for each host and
line the distinct documents are counted, where a document is its whole text, so
that exact copies count once. Lines above `max_documents` are removed; a document
is rejected as depleted if less than `min_left` of its words is left.

Counting is a distinct aggregation over hashes with map-side combining, so a
line or host that holds a third of all rows reaches a reducer as one row for each
task and document. Only the lines above the limit, joined on (host, line), go
back to the documents' line hashes; texts are never shuffled.

Defined cases: a null text has no words; a null host is a host of its own; lines
without a word are not counted or removed; a document without words fails the
base rules; rows are told apart by (id, text), so repeated rows share a verdict;
a line found in exactly as many documents as the limit allows stays; a very long text
is one document, read whole; an empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import read, shared_dir
from sparkloom.llm.textbatch import LOWER, Texts, mix, pieces

MIN_WORDS, MAX_REPEAT_SHARE, WINDOW = 10, 0.2, 5
#: A line is boilerplate if it is in more distinct documents of its host than this.
MAX_DOCUMENTS = 20
#: A document is depleted if less than this share of its words is outside boilerplate.
MIN_LEFT = 0.3

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FOLD = LOWER.copy()
_FOLD[0x30:0x3A] = 0x30


def base_counts(texts: Texts) -> tuple[np.ndarray, ...]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    starts, ends, at = texts.words()
    n_words = np.diff(at)
    size = len(texts.data)
    lead = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)]) if size else np.zeros(1, np.int64)
    chars = np.concatenate([[0], np.cumsum(lead[ends] - lead[starts])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[texts.data])]) if size else np.zeros(1, np.int64)
    sums = texts.prefix_hash()
    # repeated lines: of equal lines with a word, all but the first
    l_start, l_end, l_at = texts.lines()
    has_word = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    doc = np.repeat(np.arange(texts.n), np.diff(l_at))
    line = mix(Texts.span_hash(sums, l_start, l_end) + mix(doc.astype(np.uint64)))[has_word]
    dup = np.bincount(doc[has_word][_repeats(line)[0]], minlength=texts.n)
    # words in five-word windows found twice or more in the text
    word = Texts.span_hash(sums, starts, ends)
    owner = np.repeat(np.arange(texts.n), n_words)
    h = mix(owner.astype(np.uint64) + np.uint64(7))
    last = at[1:][owner]
    index = np.arange(len(word))
    full = index + WINDOW <= last
    padded = np.concatenate([word, np.zeros(WINDOW, np.uint64)])
    for j in range(WINDOW):
        h = (h + padded[j : j + len(word)]) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(j + 1)
    where = index[full]
    twice = where[_repeats(mix(h[full]))[1]]
    cover = np.zeros(len(word) + WINDOW + 1, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.cumsum(cover)[: len(word)] > 0
    rep = np.concatenate([[0], np.cumsum(covered)])
    o = texts.offsets
    return n_words, chars[at[1:]] - chars[at[:-1]], symbols[o[1:]] - symbols[o[:-1]], dup, rep[at[1:]] - rep[at[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions equal to an earlier one, positions that have an equal)."""
    import pandas as pd

    codes, _ = pd.factorize(keys)
    seen = np.zeros(0, np.int64)
    if not len(codes):
        return seen, seen
    many = np.bincount(codes)[codes] > 1
    first = np.zeros(len(codes), dtype=bool)
    first[np.unique(codes, return_index=True)[1]] = True
    return np.flatnonzero(many & ~first), np.flatnonzero(many)


def line_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of normalised lines with a word, words in each, text of each)."""
    starts, ends, at = texts.words()
    sums = texts.prefix_hash(_FOLD[texts.data])
    word = Texts.span_hash(sums, starts, ends)
    l_start, l_end, l_at = texts.lines()
    a, b = np.searchsorted(starts, l_start), np.searchsorted(starts, l_end)
    n = b - a
    place = np.arange(len(word)) - np.repeat(a, n)
    terms = np.concatenate([[np.uint64(0)], np.cumsum(mix(word ^ mix(place.astype(np.uint64) + np.uint64(3))), dtype=np.uint64)])
    h = mix(terms[b] - terms[a] + n.astype(np.uint64))
    keep = n > 0
    return h[keep], n[keep], np.repeat(np.arange(texts.n), np.diff(l_at))[keep]


#: Up to so many (host, line) keys above the limit are broadcast; more are joined by a shuffle.
MAX_BROADCAST_LINES = 500_000
_NAMES = ["doc_id", "host", "whole", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "sizes"]


def _scan(docs: DataFrame, host_col: str) -> DataFrame:
    """Counts and line hashes of every row, in the shared folder."""
    shared_dir(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            whole = mix(Texts.span_hash(texts.prefix_hash(), texts.offsets[:-1], texts.offsets[1:]))
            h, n, owner = line_hashes(texts)
            at = np.searchsorted(owner, np.arange(texts.n + 1)).astype(np.int32)
            cols = [pa.array(c, pa.int64()) for c in base_counts(texts)]
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (h.view(np.int64), n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole.view(np.int64)), *cols, *lists], names=_NAMES)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), "text")
    return slim.mapInArrow(scan, "doc_id long, host string, whole long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, sizes array<int>").checkpoint()


def _lines(scanned: DataFrame) -> DataFrame:
    zipped = scanned.select("doc_id", "host", "whole", F.explode(F.arrays_zip("lines", "sizes")).alias("line"))
    return zipped.select("doc_id", "host", "whole", F.col("line.lines").alias("h"), F.col("line.sizes").alias("words"), F.xxhash64(F.coalesce("host", F.lit("")), F.col("host").isNull(), "line.lines").alias("key"))


def _common(scanned: DataFrame, max_documents: int) -> DataFrame:
    """Keys of the (host, line) pairs above the limit, broadcast if their number allows it."""
    common = _lines(scanned).select("key", "whole").distinct().groupBy("key").agg(F.count("*").alias("documents")).where(F.col("documents") > max_documents).select("key").checkpoint()
    return F.broadcast(common) if common.limit(MAX_BROADCAST_LINES + 1).count() <= MAX_BROADCAST_LINES else common


def rules(docs: DataFrame, *, host_col: str = "source", max_documents: int = MAX_DOCUMENTS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row for each row of `docs`: doc_id, the base counts, base_failed, n_removed_lines, words_left, kept.

    The verdict needs a row's own line hashes only, so they are joined with the
    common ones and summed up by row: (id, text, host) with its number of rows.
    """
    scanned = _scan(docs, host_col)
    hits = _lines(scanned).join(_common(scanned, max_documents), "key", "left_semi")
    removed = hits.groupBy("doc_id", "whole", "host").agg(F.count("*").alias("n"), F.sum("words").alias("gone"))
    # repeated rows of one (id, text, host) count their lines more than once
    times = scanned.groupBy(F.col("doc_id").alias("t_doc_id"), F.col("whole").alias("t_whole"), F.col("host").alias("t_host")).agg(F.count("*").alias("times"))
    removed = removed.join(times, F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & (F.col("whole") == F.col("t_whole")) & F.col("host").eqNullSafe(F.col("t_host"))).select(
        "t_doc_id", "t_whole", "t_host", (F.col("n") / F.col("times")).cast("long").alias("n_removed_lines"), (F.col("gone") / F.col("times")).cast("long").alias("gone")
    )
    out = scanned.join(removed, F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & (F.col("whole") == F.col("t_whole")) & F.col("host").eqNullSafe(F.col("t_host")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT_SHARE) * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce("n_removed_lines", F.lit(0).cast("long")).alias("n_removed_lines"),
        left.cast("long").alias("words_left"),
        (~failed & (100 * left >= int(100 * min_left) * F.col("n_words"))).alias("kept"),
    )


def cleaned(docs: DataFrame, *, host_col: str = "source", max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """`docs` without the lines above the limit, all columns kept. Rows that share an id share the lines removed."""
    scanned = _scan(docs, host_col)
    common = _common(scanned, max_documents)
    gone = _lines(scanned).join(common, "key", "left_semi").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("h").alias("__gone"))
    fields = docs.schema.fields
    at = [f.name for f in fields].index("text")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            gone = batch.column(batch.num_columns - 1).to_pylist()
            column = batch.column(at).to_pylist()
            starts, ends, l_at = texts.lines()
            h, _, owner = line_hashes(texts)
            worded = np.flatnonzero(np.searchsorted(texts.words()[0], ends) > np.searchsorted(texts.words()[0], starts))
            keep = np.ones(len(starts), dtype=bool)
            first = np.searchsorted(owner, np.arange(texts.n + 1))
            for i, lines in enumerate(gone):
                if lines:
                    own = slice(first[i], first[i + 1])
                    keep[worded[own]] = ~np.isin(h[own].view(np.int64), np.array(lines, np.int64))
                    parts = texts.strings(starts[l_at[i] : l_at[i + 1]], ends[l_at[i] : l_at[i + 1]])
                    column[i] = "\n".join(x for x, k in zip(parts, keep[l_at[i] : l_at[i + 1]].tolist(), strict=True) if k)
            cols = [batch.column(j) for j in range(len(fields))]
            cols[at] = pa.array(column, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")), "left").drop("__id").mapInArrow(drop, docs.schema)


def op4_rules(spark, sf_dir: str) -> DataFrame:
    return rules(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, text, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
base AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols
  FROM words),
lines AS (
  SELECT r, source, text, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+') AS norm
  FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM docs)),
worded AS (SELECT * FROM lines WHERE len(norm) > 0),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY r),
windows AS (
  SELECT r, i, w[i : i + 4] AS five
  FROM (SELECT r, w, unnest(range(1, CAST(len(w) - 3 AS BIGINT))) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
common AS (SELECT source, norm FROM worded GROUP BY source, norm HAVING count(DISTINCT text) > 20),
gone AS (
  SELECT l.r, count(*) AS n, sum(len(l.norm)) AS words
  FROM worded l JOIN common c ON l.norm = c.norm AND l.source IS NOT DISTINCT FROM c.source GROUP BY l.r),
joined AS (
  SELECT b.*, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed_lines, CAST(b.n_words - coalesce(g.words, 0) AS BIGINT) AS words_left
  FROM base b LEFT JOIN dups d USING (r) LEFT JOIN covered c USING (r) LEFT JOIN gone g USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, n_removed_lines, words_left,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * words_left >= 30 * n_words AS kept
FROM joined
"""
