"""How the sources of a language differ in their words, counted by transducers.

The terms that enough documents of a language hold are sorted and cut into shards of
SHARD terms. Each shard becomes a minimal acyclic transducer: built from its sorted
terms, states with the same continuations being one state, every transition carrying
the number of terms that come before those it leads to, so that the sum along a term's
path is its ordinal in UTF-8 order. Texts are streamed through the transducers to count
terms by source, and ordinals stand for terms from then on: a task gives its counts as
arrays, one for each block of ordinals, which are merged FAN tasks at a time until one
is left, so that no group grows with the number of tasks; ties are broken by ordinals,
and only what is reported gets its term back.

Transducers are sent to the workers in slices of at most SLICE_BYTES, measured; texts
are read once for a slice, so that memory is bounded whatever the vocabulary is.

p and the divergences are integers; counts are below 9 * 10^15 (checked).

Defined cases: null text, lang and source are empty strings; every row is a document,
repeated ones too; a text of any length is counted whole (its distinct terms are held);
texts without a term count for their group; of equal values the item first in UTF-8
order ranks first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import read, shared_dir
from sparkloom.operators.sampling import dense_index

#: A term is a run of ASCII letters and characters outside ASCII.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LEAST_DOCS, SCALE, PRIOR, TOP = 10, 1_000_000_000, 2, 10
#: Terms of a transducer, and bytes of transducers that a worker holds.
SHARD, SLICE_BYTES = 131_072, 64_000_000
#: Distinct terms that a worker counts before it looks at them together, terms whose ordinals it remembers, and sums that it holds before it gives them out.
MOST_TERMS, MOST_KNOWN, MOST_SUMS = 300_000, 600_000, 2_000_000
#: Ordinals of a block, cells of the matrix (sources, ordinals) that is held at a time, and tasks whose counts of a block are merged at a time.
BLOCK, CELLS, FAN = 2048, 1_000_000, 256
#: Groups up to this number are broadcast, some 60 bytes each.
MAX_BROADCAST_GROUPS = 50_000


class Transducer:
    """Maps the terms of a set to their ordinals in byte order.

    Transitions are sorted by `keys`, state * 256 + byte; `target` and `before` are
    where they lead and how many terms of their state come earlier.
    """

    def __init__(self, keys: np.ndarray, target: np.ndarray, before: np.ndarray, final: np.ndarray, root: int, size: int):
        self.keys, self.target, self.before, self.final, self.root, self.size = keys, target, before, final, root, size

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in ascending byte order."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []
        reach: list[int] = []
        path: list[list] = [[False, []]]  # the states of the last term, not final yet: accepts, transitions so far

        def settle(open_state: list) -> int:
            what = (open_state[0], tuple(open_state[1]))
            at = register.setdefault(what, len(states))
            if at == len(states):
                states.append(what)
                reach.append(int(what[0]) + sum(reach[t] for _, t in what[1]))
            return at

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                at = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], at))

        last, size = b"", 0
        for term in terms:
            if size and term <= last:
                raise ValueError("terms are not sorted and distinct")
            same = 0
            while same < min(len(last), len(term)) and last[same] == term[same]:
                same += 1
            close(same)
            path.extend([False, []] for _ in term[same:])
            path[-1][0] = True
            last, size = term, size + 1
        close(0)
        root = settle(path[0])
        keys, target, before = [], [], []
        for at, (accepts, moves) in enumerate(states):
            n = int(accepts)
            for byte, to in moves:
                keys.append(at << 8 | byte)
                target.append(to)
                before.append(n)
                n += reach[to]
        return cls(np.array(keys, np.int64), np.array(target, np.int32), np.array(before, np.int32), np.array([a for a, _ in states], bool), root, size)

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """The ordinal of each term, -1 for those outside the set. All terms advance together, a byte at a time."""
        out = np.full(len(terms), -1, np.int64)
        length = np.fromiter(map(len, terms), np.int64, len(terms))
        start = np.cumsum(length) - length
        data = np.frombuffer(b"".join(terms), np.uint8)
        live, state, total = np.arange(len(terms)), np.full(len(terms), self.root, np.int64), np.zeros(len(terms), np.int64)
        j = 0
        while len(live):
            ended = length[live] == j
            hit = ended & self.final[state]
            out[live[hit]] = total[hit]
            live, state, total = live[~ended], state[~ended], total[~ended]
            key = state << 8 | data[start[live] + j]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            there = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            at = at[there]
            live, state, total = live[there], self.target[at].astype(np.int64), total[there] + self.before[at]
            j += 1
        return out

    def to_bytes(self) -> bytes:
        return pickle.dumps((self.keys, self.target, self.before, self.final, self.root, self.size))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Transducer:
        return cls(*pickle.loads(raw))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "source", "text")), strict=True)


def _clean(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, ordinal) of the terms that at least `least` documents of the language hold; docs: lang, source, text without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(lang.decode(), len(found)), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "term", "docs"])
            held.clear()

        for batch in batches:
            for lang, _, text in _rows(batch):
                held.setdefault(lang, Counter()).update(set(TERM.findall(text.lower())))
                if sum(map(len, held.values())) > MOST_TERMS:
                    yield from flush()
        yield from flush()

    found = docs.mapInArrow(run, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
    numbered = dense_index(found.where(F.col("docs") >= least).select("lang", "term"), "lang", "term").checkpoint()
    first = numbered.groupBy("lang").agg(F.min("local_id").alias("first"))
    return numbered.join(F.broadcast(first), "lang").select("lang", "term", (F.col("local_id") - F.col("first")).alias("ordinal"))


def transducers(vocabulary: DataFrame, shard: int = SHARD) -> DataFrame:
    """(lang, shard, machine): one transducer for each `shard` consecutive ordinals of a language."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        terms = table.sort_by("ordinal").column("term").cast(pa.binary()).to_pylist()
        return pa.table({"lang": [key[0].as_py()], "shard": pa.array([key[1].as_py()], pa.int64()), "machine": pa.array([Transducer.build(terms).to_bytes()], pa.binary())})

    return vocabulary.withColumn("shard", F.floor(F.col("ordinal") / shard).cast("long")).groupBy("lang", "shard").applyInArrow(build, "lang string, shard long, machine binary")


_COUNTS = "task int, lang string, source string, block long, total long, ordinals array<int>, counts array<long>"


def recount(docs: DataFrame, machines: DataFrame, shard: int = SHARD, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(task 0, lang, source, block, total, ordinals, counts): how often the kept terms of a block occur in a group, from streaming the texts through the transducers. Ordinals are places in the block."""
    spark = docs.sparkSession
    sizes = [tuple(r) for r in machines.select("lang", "shard", F.length("machine")).collect()]  # a row for each transducer
    slices, room = [[]], slice_bytes
    for lang, number, size in sorted(sizes):
        if slices[-1] and size > room:
            slices.append([])
            room = slice_bytes
        slices[-1].append((lang, number))
        room -= size
    parts = []
    for chosen in slices:
        wanted = spark.createDataFrame(chosen, "lang string, shard long")
        held: dict[bytes, list] = {}
        for lang, number, machine in machines.join(F.broadcast(wanted), ["lang", "shard"]).collect():
            held.setdefault(lang.encode(), []).append((number * shard, bytes(machine)))
        parts.append(_streamed(docs, spark.sparkContext.broadcast(held)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    tasks = 1 + (out := out.checkpoint()).agg(F.coalesce(F.max("task"), F.lit(0))).first()[0]
    while True:
        tasks = -(-tasks // FAN)
        out = out.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("lang", "source", "block", "task").applyInArrow(_summed, _COUNTS)
        if tasks == 1:
            return out
        out = out.checkpoint()


def _arrays(ordinals: np.ndarray, counts: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """total, ordinals and counts of the stretches between places `at`."""
    offsets = pa.array(at, pa.int32())
    totals = np.diff(np.concatenate([[0], np.cumsum(counts)])[at])
    return [pa.array(totals, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ordinals, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    n = np.zeros(BLOCK, np.int64)
    np.add.at(n, table.column("ordinals").combine_chunks().flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy())
    some = np.flatnonzero(n)
    lang, source, block, task = key
    names = [pa.array([x.as_py()], t) for x, t in ((task, pa.int32()), (lang, pa.string()), (source, pa.string()), (block, pa.int64()))]
    return pa.Table.from_arrays([*names, *_arrays(some, n[some], np.array([0, len(some)]))], names=_NAMES)


_NAMES = [x.split()[0] for x in _COUNTS.split(", ")]


def _streamed(docs: DataFrame, sent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = {lang: [(first, Transducer.from_bytes(raw)) for first, raw in found] for lang, found in sent.value.items()}
        known: dict[bytes, dict[bytes, int]] = {lang: {} for lang in machines}
        held: dict[tuple, Counter] = {}
        sums: dict[tuple, list] = {}
        task = TaskContext.get().partitionId()

        def look_up() -> None:
            """Counted terms become sums by ordinal. A term goes through the transducers once, while it is remembered."""
            for (lang, source), found in held.items():
                own = known[lang]
                if len(own) > MOST_KNOWN:
                    own.clear()
                fresh = [t for t in found if t not in own]
                at = np.full(len(fresh), -1, np.int64)
                for first, machine in machines[lang]:
                    place = machine.ordinals(fresh)
                    at[place >= 0] = place[place >= 0] + first
                own.update(zip(fresh, at.tolist(), strict=True))
                at = np.fromiter(map(own.__getitem__, found), np.int64, len(found))
                n = np.fromiter(found.values(), np.int64, len(found))
                sums.setdefault((lang, source), []).append((at[at >= 0], n[at >= 0]))
            held.clear()

        def merge() -> int:
            for group, parts in sums.items():
                if len(parts) > 1 or not (np.diff(parts[0][0]) > 0).all():
                    at, place = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
                    n = np.zeros(len(at), np.int64)
                    np.add.at(n, place, np.concatenate([n for _, n in parts]))
                    sums[group] = [(at, n)]
            return sum(len(parts[0][0]) for parts in sums.values())

        def give() -> Iterator[pa.RecordBatch]:
            merge()
            for (lang, source), parts in sums.items():
                at, n = parts[0]
                block = at // BLOCK
                begin = np.flatnonzero(np.concatenate([[True], np.diff(block) > 0])) if len(at) else np.zeros(0, np.int64)
                names = [pa.array(np.full(len(begin), task, np.int32)), *[pa.repeat(x.decode(), len(begin)) for x in (lang, source)], pa.array(block[begin])]
                yield pa.RecordBatch.from_arrays([*names, *_arrays(at % BLOCK, n, np.append(begin, len(at)))], names=_NAMES)
            sums.clear()

        for batch in batches:
            for lang, source, text in _rows(batch):
                if lang in machines:
                    held.setdefault((lang, source), Counter()).update(TERM.findall(text.lower()))
                    if sum(map(len, held.values())) > MOST_TERMS:
                        look_up()
                        if merge() > MOST_SUMS:
                            yield from give()
        look_up()
        yield from give()

    return docs.mapInArrow(run, _COUNTS)


def smoothed(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), exact: long division by thousands."""
    rest, out = np.broadcast_to(count + PRIOR, np.broadcast(count, total).shape).astype(np.int64), 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """Rows of a block of ordinals: each group's total and the language's number of terms (no arrays), and its counts. Gives parts of the pairs' sums, and each group's TOP terms of the block."""
    lang = key[0].as_py()
    side = table.filter(pc.is_null(table.column("ordinals")))
    order = np.argsort(np.array([s.encode() for s in side.column("source").to_pylist()], dtype=object), kind="stable")
    names = [side.column("source")[int(i)].as_py() for i in order]
    total, vocabulary = side.column("total").to_numpy()[order].astype(np.int64), int(side.column("terms")[0].as_py())
    if int(total.sum()) + PRIOR * vocabulary >= 9 * 10**15:
        raise ValueError("too many terms for exact 64-bit arithmetic")
    at = {s: i for i, s in enumerate(names)}
    cells = table.filter(pc.is_valid(table.column("ordinals")))
    base, end = key[1].as_py() * BLOCK, min((key[1].as_py() + 1) * BLOCK, vocabulary)
    row = np.repeat(np.array([at[s] for s in cells.column("source").to_pylist()], np.int64), pc.list_value_length(cells.column("ordinals")).to_numpy())
    ordinal, n = (cells.column(c).combine_chunks().flatten().to_numpy() for c in ("ordinals", "counts"))
    ordinal = ordinal.astype(np.int64) + base
    sums = np.zeros((len(names), len(names)), np.int64)
    best: list[list[tuple]] = [[] for _ in names]
    width = max(1, CELLS // len(names))
    for low in range(base, end, width):
        high = min(low + width, end)
        mine = (ordinal >= low) & (ordinal < high)
        count = np.zeros((len(names), high - low), np.int64)
        count[row[mine], ordinal[mine] - low] = n[mine]
        p = smoothed(count, (total + PRIOR * vocabulary)[:, None])
        q = smoothed(count.sum(axis=0), total.sum() + PRIOR * vocabulary)
        for i in range(len(names)):
            sums[i, i + 1 :] += apart(p[i + 1 :], p[i]).sum(axis=1)
            some = np.flatnonzero((count[i] > 0) & (p[i] > q))
            value = apart(p[i][some], q[some])
            first = np.lexsort((some, -value))[:TOP]
            best[i] = sorted(best[i] + [(-int(v), int(o) + low) for v, o in zip(value[first], some[first], strict=True)])[:TOP]
    i, j = np.triu_indices(len(names), 1)
    out = {"source": [names[x] for x in i.tolist()], "other": [names[x] for x in j.tolist()], "ordinal": [None] * len(i), "value": sums[i, j].tolist()}
    for name, found in zip(names, best, strict=True):
        out["source"] += [name] * len(found)
        out["other"] += [None] * len(found)
        out["ordinal"] += [o for _, o in found]
        out["value"] += [-v for v, _ in found]
    types = {"source": pa.string(), "other": pa.string(), "ordinal": pa.int64(), "value": pa.int64()}
    return pa.table({"lang": pa.array([lang] * len(out["value"]), pa.string())} | {c: pa.array(v, types[c]) for c, v in out.items()})


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from every other, and the TOP terms that set it off from the language."""
    spark = docs.sparkSession
    shared_dir(spark)
    docs = _clean(docs)
    vocabulary = kept_terms(docs, least).checkpoint()
    counts = recount(docs, transducers(vocabulary).checkpoint()).checkpoint()
    terms = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")).checkpoint()
    small = groups.count() <= MAX_BROADCAST_GROUPS
    blocks = vocabulary.select("lang", F.floor(F.col("ordinal") / BLOCK).cast("long").alias("block")).distinct()
    none = F.lit(None)
    sides = blocks.join(F.broadcast(groups) if small else groups, "lang").select("lang", "block", "source", "total", "terms", none.cast("array<int>").alias("ordinals"), none.cast("array<long>").alias("counts"))
    cells = counts.select("lang", "block", "source", "total", none.cast("long").alias("terms"), "ordinals", "counts")
    found = sides.unionByName(cells).groupBy("lang", "block").applyInArrow(_block, "lang string, source string, other string, ordinal long, value long").checkpoint()

    sums = found.where("other IS NOT NULL").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    names = groups.select("lang", "source")
    others = names.withColumnRenamed("source", "other")
    pairs = names.join(F.broadcast(others) if small else others, "lang").where("source <> other").join(both, ["lang", "source", "other"], "left")
    own = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "item")))
    top = found.where("other IS NULL").withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= TOP)
    top = top.join(vocabulary, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(top)


def op13_source_audit(spark, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
per_doc AS (SELECT lang, source, doc, term, count(*) AS n FROM (SELECT lang, source, doc, unnest(found) AS term FROM d) GROUP BY lang, source, doc, term),
kept AS (SELECT lang, term FROM per_doc GROUP BY lang, term HAVING count(*) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS terms FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM per_doc SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
total AS (SELECT grp.lang, grp.source, coalesce(sum(n), 0)::HUGEINT AS total FROM grp LEFT JOIN c USING (lang, source) GROUP BY grp.lang, grp.source),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR}) // (t.total + {PRIOR} * v.terms) AS p
  FROM total t JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (
  SELECT lang, term, 1 + {SCALE}::HUGEINT * (sum(n) + {PRIOR}) // (any_value(whole) + {PRIOR} * any_value(terms)) AS q
  FROM p JOIN (SELECT lang, sum(total) AS whole FROM total GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(s.value), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= {TOP}
"""
