"""Near-duplicate classes by Order MinHash and banded alignment.

Words are runs of letters and digits, ASCII letters folded. Every text's windows
of K words are labelled with their occurrence number in it; for each of SKETCHES
hash orders the ELL least labelled windows are taken, put in text order, and
hashed together. Unlike plain MinHash the tuple changes when passages change
places, so that it follows edit similarity. Texts that share a tuple (a bucket)
are candidates. A candidate counts if the word edit distance, by dynamic
programming in a diagonal band that is widened until it is exact, is at most
(1 - SIMILARITY) of the longer text. Classes are the connected components.

Pairs inside a bucket are never listed whole. Each text is compared with one
centre: of the best members of its buckets, the one that sits in the largest
buckets; then with the centres of its other buckets, unless they met the same one. What
verifies is joined. Then the rest is settled exactly. Where all members of a bucket but
FEW or less are in one class, those few meet all the others. Other buckets are cut
into blocks of about BLOCK texts or BLOCK_WORDS words; each member outside the
largest class meets, block by block, all members of other classes, first by lengths
and counts of words. That takes steps in the square of what is outside (64 bytes for
a pair), but no rows: a block gives one row of candidates, and the words of their
texts are sent to it once.

Texts of few words, where one edit can hit all windows, are compared whatever their
tuples are: texts of L words within D = (1 - SIMILARITY) L edits share L - 1 - 2 D
labelled word pairs at least, so some pair is among the first of both in any one
order; hashes counted seldom come first. Those pairs then serve as buckets.

Texts with equal word sequences are one node from the start, so a hot group of
copies enters every later step once.

Defined cases: a null text is an empty one; texts without words are near
duplicates of equal texts only; rows that share an id are one document; a null id
is replaced by a number of 2^62 or more from the text's hash, so that real ids lead
their classes, and reported as null; a class of null ids only has such a number for
its class id; of equally good centres the one with the greater hash is taken, which
moves work and no result but where an alignment was skipped as both texts were in one
class; an empty table gives an empty result; other columns are not read (`stage`
passes them on; columns that begin with __near_ are reserved). Texts are compared
whole: n words with d edits take about n d steps, n^2 / 5 at worst (pairs whose words
alone show more than n / 5 edits are dropped before), in memory of n + d.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import read, release, shared_dir
from sparkloom.llm.textbatch import LOWER, Texts, mix, pieces, ranges

#: Where one word in five is edited nearly no window of five words is left whole. 48 tuples of three word pairs find 0.96 of the pairs
#: at the very threshold or more, at any length, even with edits spread evenly (tests/llm/measure_recall.py).
K, ELL, SKETCHES, SIMILARITY = 2, 3, 48, 0.8
#: Bits of a window's place below its hash; a text in an Arrow batch has fewer words.
PLACE = np.uint64(30)
#: Texts that are alike to texts of less than SHORT words are compared by the exact join.
SHORT = 16
#: Buckets with at most FEW members outside their largest class are settled by pairs, others by blocks.
FEW = 32
BLOCK, BLOCK_WORDS, BLOCK_PAIRS = 1024, 2_000_000, 32_768
#: Counts of words by hash, 255 at most, for a quick lower bound of the distance.
BINS = 64


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = texts.tokens()
    return Texts.span_hash(texts.prefix_hash(LOWER[texts.data]), starts, ends), at


def labelled_windows(word: np.ndarray, at: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words (a shorter text is one window) with their occurrence numbers, and the first window of each text."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    start = ranges(at[:-1], count)
    owner = np.repeat(np.arange(len(n)), count)
    stop = at[1:][owner]
    h = np.zeros(len(start), dtype=np.uint64)
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    for j in range(k):
        h = h * np.uint64(0x100000001B3) + np.where(start + j < stop, padded[start + j], np.uint64(j))
    h = mix(h)
    # equal windows of one text get the numbers 1, 2, ... in text order
    import pandas as pd

    codes, _ = pd.factorize(h + mix(owner.astype(np.uint64) + np.uint64(1)))
    many = np.flatnonzero((np.bincount(codes) > 1)[codes]) if len(codes) else np.zeros(0, np.int64)
    if len(many):
        order = many[np.argsort(codes[many], kind="stable")]
        c = codes[order]
        begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        nth = np.arange(len(c)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(c)]])))
        h[order] = mix(h[order] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, first


def sketch(word: np.ndarray, at: np.ndarray, k: int = K, ell: int = ELL, sketches: int = SKETCHES) -> np.ndarray:
    """(texts, sketches) hashes of the ell least labelled windows in text order; texts without words get zeros."""
    h, first = labelled_windows(word, at, k)
    n = len(at) - 1
    out = np.zeros((n, sketches), dtype=np.uint64)
    some = np.flatnonzero(np.diff(first) > 0)
    if not len(some):
        return out
    begin = first[:-1][some]
    place = ranges(np.zeros(len(some), np.int64), np.diff(first)[some]).astype(np.uint64)
    top, low = np.uint64(2**64 - 1), (np.uint64(1) << PLACE) - np.uint64(1)
    for s in range(sketches):
        g = h * np.uint64(int(mix(np.array([s + 1], np.uint64))[0]) | 1)
        g ^= g >> np.uint64(29)
        g &= ~low
        g |= place
        where, what = [], []
        for _ in range(ell):
            least = np.minimum.reduceat(g, begin)
            done = least == top
            at_hit = begin + np.where(done, np.uint64(0), least & low).astype(np.int64)
            where.append(np.where(done, 2**62, at_hit))
            what.append(np.where(done, np.uint64(0), h[at_hit]))
            g[at_hit] = top
        order = np.argsort(np.stack(where), axis=0, kind="stable")
        tuples = np.take_along_axis(np.stack(what), order, axis=0)
        value = np.full(len(some), s + 1, dtype=np.uint64)
        for row in tuples:
            value = mix(value * np.uint64(31) + row)
        out[some, s] = value
    return out


def _id() -> Column:
    """The document's id; for a null one a number above the usual ids, from the text's hash."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62))


def _signatures(docs: DataFrame) -> DataFrame:
    """(id, made, ha, hb, n, bins, sk): id, whether it stands for a null, 128-bit hash of the word sequence, number of words, their counts by hash, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            word, at = _words(texts)
            n = np.diff(at)
            raw = Texts.span_hash(texts.prefix_hash(), texts.offsets[:-1], texts.offsets[1:])
            hashes = []
            for salt in (np.uint64(0x51ED270B27B4F3CF), np.uint64(0xD6E8FEB86659FD93)):
                place = np.arange(len(word), dtype=np.uint64) - np.repeat(at[:-1], n).astype(np.uint64)
                terms = mix(word ^ mix((place + np.uint64(1)) * salt))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
                hashes.append(mix(np.where(n > 0, sums[at[1:]] - sums[at[:-1]], raw) * salt + n.astype(np.uint64)))
            sk = sketch(word, at)
            flat = pa.array(sk.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sk.size + 1, sk.shape[1], dtype=np.int32)), flat)
            bins = np.bincount(np.repeat(np.arange(texts.n), n) * BINS + (word >> np.uint64(58)).astype(np.int64), minlength=texts.n * BINS).reshape(-1, BINS)
            bins = pa.array([x.tobytes() for x in np.minimum(bins, 255).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes[0].view(np.int64)), pa.array(hashes[1].view(np.int64)), pa.array(n), bins, lists], names=["id", "made", "ha", "hb", "n", "bins", "sk"])

    return docs.select(_id().alias("id"), F.col("doc_id").cast("long").isNull().alias("made"), "text").mapInArrow(run, "id long, made boolean, ha long, hb long, n long, bins binary, sk array<long>")


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Lower bound of the edit distance: what the longer bag has over the common part."""
    both = np.concatenate([a, b])
    side = np.concatenate([np.ones(len(a), np.int64), -np.ones(len(b), np.int64)])
    order = np.argsort(both, kind="stable")
    v = both[order]
    begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    net = np.add.reduceat(side[order], begin) if len(begin) else np.zeros(0, np.int64)
    return int(max(net[net > 0].sum(), -net[net < 0].sum()))


def banded_distance(left: list[np.ndarray], right: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distances of pairs within `band` diagonals of the main one; values above `band` are upper bounds.

    All pairs advance together by rows of the first text.
    """
    p = len(left)
    n = np.array([len(x) for x in left])
    m = np.array([len(x) for x in right])
    width = 2 * band + 1
    rows = int(n.max(initial=0))
    a = np.zeros((p, rows), dtype=np.uint32)
    b = np.zeros((p, rows + width + 1), dtype=np.uint32)  # b[:, band + j] is word j
    for i in range(p):
        a[i, : n[i]] = left[i]
        keep = min(m[i], rows + band + 1)
        b[i, band : band + keep] = right[i][:keep]
    far = np.int32(1 << 28)
    k = np.arange(width, dtype=np.int32)
    j0 = k[None, :] - band
    d = np.where((j0 >= 0) & (j0 <= m[:, None]), j0, far).astype(np.int32)
    out = np.full(p, far, dtype=np.int64)
    at_end = m - n + band
    inside = (at_end >= 0) & (at_end < width)
    zero = np.flatnonzero((n == 0) & inside)
    out[zero] = d[zero, at_end[zero]]
    cost = np.empty_like(d)
    for i in range(1, rows + 1):
        # cell (i, j) with j = i + k - band; word j - 1 of the second text is b[:, band + j - 1] = b[:, i + k - 1]
        np.not_equal(b[:, i - 1 : i - 1 + width], a[:, i - 1 : i], out=cost, casting="unsafe")
        cost += d
        np.minimum(cost[:, :-1], d[:, 1:] + 1, out=cost[:, :-1])
        j = i + k - band
        if i <= band:
            cost[:, j < 0] = far
            cost[:, j == 0] = i
        cost -= k
        np.minimum.accumulate(cost, axis=1, out=cost)
        cost += k
        if i + band > m.min():
            cost[j[None, :] > m[:, None]] = far
        d, cost = cost, d
        done = np.flatnonzero((n == i) & inside)
        if len(done):
            out[done] = d[done, at_end[done]]
    return out


def _cores(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common beginning and end, which leaves the distance as it is."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    begin = int(differ[0]) if len(differ) else n
    a, b = a[begin:], b[begin:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    end = int(differ[0]) if len(differ) else n
    return a[: len(a) - end], b[: len(b) - end]


def similarities(left: list[np.ndarray], right: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """1 - distance / longer length where that is at least `similarity`, else 0; exact."""
    out = np.zeros(len(left))
    whole = np.array([max(len(a), len(b)) for a, b in zip(left, right, strict=True)], dtype=np.int64)
    limits = ((1 - similarity) * whole + 1e-9).astype(np.int64).tolist()
    cores = [_cores(a, b) for a, b in zip(left, right, strict=True)]
    todo: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(cores):
        if abs(len(a) - len(b)) > limits[i]:
            continue
        if max(len(a), len(b)) <= limits[i] and not min(len(a), len(b)):
            out[i] = 1.0 if not whole[i] else 1 - max(len(a), len(b)) / whole[i]
            continue
        bag = bag_distance(a, b)
        if bag <= limits[i]:
            todo.setdefault(min(_up(bag + 4), _up(limits[i])), []).append(i)
    while todo:
        band = min(todo)
        items = sorted(todo.pop(band), key=lambda i: len(cores[i][0]))
        while items:
            take, least = 1, len(cores[items[0]][0])
            while take < len(items) and take * (len(cores[items[take]][0]) + 2 * band) < 400_000 and len(cores[items[take]][0]) <= 1.3 * least + 16:
                take += 1
            group, items = items[:take], items[take:]
            for i, d in zip(group, banded_distance([cores[i][0] for i in group], [cores[i][1] for i in group], band).tolist(), strict=True):
                if d <= limits[i] and d <= band:
                    out[i] = 1 - d / whole[i]
                elif band < limits[i]:
                    todo.setdefault(2 * band, []).append(i)
    return out


def _up(x: int) -> int:
    return 1 << max(3, int(x - 1).bit_length()) if x > 1 else 8


def _word_ids(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, words): 32-bit hashes of the words of the needed documents' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            word, at = _words(texts)
            short = (word >> np.uint64(32)).astype(np.uint32)
            rows = [short[at[i] : at[i + 1]].tobytes() for i in range(texts.n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["node", "words"])

    # copies without an id share their number: one of them is enough
    nameless = docs.where("doc_id IS NULL").select("text").distinct().select(F.lit(None).cast("long").alias("doc_id"), "text")
    every = docs.where("doc_id IS NOT NULL").select("doc_id", "text").unionByName(nameless).select(_id().alias("node"), "text")
    return every.join(needed, "node", "left_semi").dropDuplicates(["node", "text"]).mapInArrow(run, "node long, words binary")


def _prefixes(words: DataFrame, similarity: float) -> DataFrame:
    """(words: node, words) -> (node, n, key): each text's labelled word pairs, the seldom ones, as many as it takes to share one with any text similar enough.

    The order is by counts of 65,536 hash values, summed over all texts; every order
    gives the same result.
    """

    def windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]
        n = np.array([len(x) for x in rows])
        h, first = labelled_windows(np.concatenate(rows).astype(np.uint64), np.concatenate([[0], np.cumsum(n)]), 2)
        return n, h, first

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                yield whole.slice(start, 512)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in slices(batches):
            total += np.bincount((windows(batch)[1] >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "rows"])

    counted = words.mapInArrow(count, "slot long, rows long").groupBy("slot").agg(F.sum("rows").alias("rows")).toArrow()
    often = np.zeros(1 << 16, dtype=np.int64)
    often[counted["slot"].to_numpy()] = counted["rows"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, h, first = windows(batch)
            size = np.diff(first)
            owner = np.repeat(np.arange(len(n)), size)
            order = np.lexsort((h, often[(h >> np.uint64(48)).astype(np.int64)], owner))
            take = ranges(first[:-1], np.minimum(size, size - shared_pairs(n, similarity) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[take])), pa.array(n[owner[take]]), pa.array(h[order][take].view(np.int64))], names=["node", "n", "key"])

    return words.mapInArrow(run, "node long, n long, key long")


def shared_pairs(n: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Least number of labelled word pairs that a text of n words shares with any similar one as long or longer, 1 at least."""
    least = np.full(len(n), 2**62)
    longest = np.floor(n / similarity + 1e-9).astype(np.int64)
    for more in range(int((longest - n).max(initial=0)) + 1):
        length = np.minimum(n + more, longest)
        least = np.minimum(least, length - 1 - 2 * np.floor((1 - similarity) * length + 1e-9).astype(np.int64))
    return np.maximum(least, 1)


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b, wa, wb) -> (a, b) of those similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                left = [np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]
                right = [np.frombuffer(x, np.uint32) for x in batch.column(3).to_pylist()]
                yield batch.filter(pa.array(similarities(left, right, similarity) > 0)).select(["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all ends of the edges (a, b), root the least of its component: alternating large and small stars.

    Every round is cut by a reliable checkpoint; what the driver sees is one row
    for each round.
    """

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct().checkpoint()
    before = None
    while (state := summary(now)) != before:
        before = state
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        now = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct().checkpoint()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, made) for each row of `docs`; class_id is the least id of the class, `made` tells ids that stand for nulls."""
    shared_dir(docs.sparkSession)
    signed = _signatures(docs).checkpoint()
    own = Window.partitionBy("ha", "hb").orderBy("id")
    first = signed.withColumn("nth", F.row_number().over(own)).where("nth = 1").withColumnRenamed("id", "node")
    low = F.transform("sk", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))
    heads = first.select("node", "ha", "hb", "n", "bins", low.alias("tags")).checkpoint()
    signed, sizes = signed.select("id", "made", "ha", "hb"), heads.select("node", "n", "bins")
    # the members of all buckets of two texts or more
    rows = first.where("n > 0").select("node", F.explode("sk").alias("key")).repartition("key")
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = rows.join(shared, "key").join(sizes.select("node", "n"), "node").checkpoint()
    ends = heads.where((F.col("n") * similarity < SHORT) & (F.floor(F.col("n") * (1 - similarity) + 1e-9) + F.floor(F.col("n") / similarity * (1 - similarity) + 1e-9) > 0)).select("node")
    words = _word_ids(members.select("node").unionByName(ends).distinct(), docs).checkpoint()
    release(docs.sparkSession)
    # rows that share an id with another text join that text's class
    twins = signed.groupBy("id").agg(F.min("ha").alias("x"), F.max("ha").alias("y")).where("x != y").select("id")
    ties = signed.join(twins, "id").join(heads.select("ha", "hb", "node"), ["ha", "hb"]).select(F.col("id").alias("a"), F.col("node").alias("b"))
    found = ties.where("a != b").distinct().checkpoint()
    # the centre of a bucket: the member that sits in the largest buckets
    fame = members.groupBy("node").agg(F.sum("members").alias("fame"))
    centre = members.join(fame, "node").groupBy("key").agg(F.max(F.struct("fame", F.xxhash64("node").alias("h"), F.col("node").alias("to"), F.col("n").alias("size"))).alias("c"))
    like = F.least("n", "c.size") >= F.lit(similarity) * F.greatest("n", "c.size")
    options = members.join(centre, "key").where((F.col("node") != F.col("c.to")) & like).select("node", "c").distinct().checkpoint()
    best = options.groupBy("node").agg(F.max("c").alias("c")).select("node", F.col("c.to").alias("to")).checkpoint()
    linked = _compared(_pairs(best), sizes, words, similarity).checkpoint()
    # a text and the centres it has met are one class so far; the other centres of its buckets follow
    near = best.withColumn("a", F.least("node", "to")).withColumn("b", F.greatest("node", "to")).join(linked, ["a", "b"], "left_semi").select("node", F.col("to").alias("root"))
    rest = _named(_named(options.select("node", F.col("c.to").alias("to")), near, "node", "class"), near, "to", "other").where("class != other AND class != to").select("node", "to")
    rest = rest.join(best, ["node", "to"], "left_anti").checkpoint()
    found = found.unionByName(linked).unionByName(_compared(_pairs(rest), sizes, words, similarity)).checkpoint()
    tested, labels = _pairs(best.unionByName(rest)), components(found)
    release(docs.sparkSession)
    # what is open still
    tuples = _open(_named(members.drop("members"), labels, "node", "class")).withColumn("once", F.lit(True))
    short = _prefixes(words.join(ends, "node", "left_semi"), similarity)
    common = short.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    brief = _open(_named(short.join(common, "key"), labels, "node", "class")).withColumn("once", F.lit(False))
    still = tuples.unionByName(brief.select(tuples.columns)).checkpoint()
    release(docs.sparkSession)
    pairs = _across(still.where(F.col("outside") <= FEW), similarity).join(tested, ["a", "b"], "left_anti")
    links = _compared(pairs, sizes, words, similarity)
    links = links.unionByName(_blocked(still.where(F.col("outside") > FEW), heads.select("node", "bins", "tags"), words, similarity))
    # the classes of classes
    between = _named(_named(links, labels, "a", "x"), labels, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    classes = components(between).select(F.col("node").alias("class"), F.col("root").alias("top"))
    # documents -> their text's first document -> its class
    heads = _named(heads.select("ha", "hb", "node"), labels, "node", "class").join(classes, "class", "left").withColumn("class_id", F.coalesce("top", "class"))
    return signed.join(heads.select("ha", "hb", "class_id"), ["ha", "hb"]).select(F.col("id").alias("doc_id"), "class_id", "made")


def _named(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """`rows` with the class of column `node`; a node without links is its own class."""
    classes = labels.select(F.col("node").alias(node), F.col("root").alias(name))
    return rows.join(classes, node, "left").withColumn(name, F.coalesce(name, node))


def _open(members: DataFrame) -> DataFrame:
    """(key, node, n, class) of keys with several classes, with the largest class, `main`, the number of members `outside` it, and the number of `blocks` to cut the key into."""
    members = members.checkpoint()
    counts = members.groupBy("key", "class").agg(F.count("*").alias("rows"), F.sum("n").alias("words"))
    split = counts.groupBy("key").agg(F.max(F.struct("rows", "class")).alias("main"), F.sum("rows").alias("all"), F.sum("words").alias("words"))
    blocks = F.ceil(F.greatest(F.col("all") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    split = split.where(F.col("main.rows") < F.col("all")).select("key", F.col("main.class").alias("main"), (F.col("all") - F.col("main.rows")).alias("outside"), blocks.alias("blocks"))
    return members.join(split, "key")


def _pairs(rows: DataFrame) -> DataFrame:
    """(node, to) -> (a, b), the lesser node first."""
    return rows.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b"))


def _across(members: DataFrame, similarity: float) -> DataFrame:
    """(key, node, n, class, main) -> (a, b): members outside the key's main class with all members of other classes and like length."""
    small = members.where("class != main").select("key", *[F.col(c).alias(f"{c}_") for c in ("node", "n", "class")])
    like = F.least("n", "n_") >= F.lit(similarity) * F.greatest("n", "n_")
    return small.join(members, "key").where((F.col("class") != F.col("class_")) & like).select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()


def _blocked(members: DataFrame, slim: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those similar enough, a outside the main class of a key and b of another class than a.

    Every block of members outside meets every block of all members. Where `once` is
    set, a pair is looked at only in the first of all tuples that both texts share.
    """

    def candidates(key: tuple, table: pa.Table) -> pa.Table:
        # numbers of the rows of each side, then one row of the left side against all of the right
        low = np.uint32(key[0].as_py() & 0xFFFFFFFF)
        node, n, group = (table.column(c).to_numpy() for c in ("node", "n", "class"))
        side, once, main = (table.column(c).to_numpy(zero_copy_only=False) for c in ("side", "once", "in_main"))
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
        tags = table.column("tags").combine_chunks().flatten().to_numpy().view(np.uint32).reshape(len(node), -1)
        right = np.flatnonzero(side)
        a, b = [], []
        for i in np.flatnonzero(~side):
            at = right[(group[right] != group[i]) & (np.minimum(n[right], n[i]) >= similarity * np.maximum(n[right], n[i])) & (main[right] | (node[i] < node[right]))]
            more = bins[at] - bins[i]
            gain = np.maximum(more, 0).sum(axis=1)
            apart = np.maximum(gain, gain - more.sum(axis=1))
            at = at[apart <= np.floor((1 - similarity) * np.maximum(n[at], n[i]) + 1e-9)]
            if once[i]:
                same = tags[at] == tags[i]
                at = at[tags[at, same.argmax(axis=1)] == low]
            a.append(np.full(len(at), node[i]))
            b.append(node[at])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        cuts = range(0, len(a), BLOCK_PAIRS)
        name = hash(tuple(x.as_py() for x in key)) & (2**62 - 1)
        parts = [pa.array([x[i : i + BLOCK_PAIRS] for i in cuts], pa.list_(pa.int64())) for x in (a, b)]
        return pa.table({"block": pa.array([name ^ i for i in cuts], pa.int64()), "a": parts[0], "b": parts[1]})

    def verified(table: pa.Table) -> pa.Table:
        text = {k: np.frombuffer(v, np.uint32) for k, v in zip(table.column("node").to_pylist(), table.column("words").to_pylist(), strict=True) if k is not None}
        a, b = (np.concatenate([np.zeros(0, np.int64), *[x for x in table.column(c).to_pylist() if x]]).astype(np.int64) for c in ("a", "b"))
        keep = [np.zeros(0, bool)]
        for i in range(0, len(a), 512):
            keep.append(similarities([text[x] for x in a[i : i + 512].tolist()], [text[x] for x in b[i : i + 512].tolist()], similarity) > 0)
        keep = np.concatenate(keep)
        return pa.table({"a": a[keep], "b": b[keep]})

    rows = members.withColumn("in_main", F.col("class") == F.col("main")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.join(slim, "node").select("key", "node", "n", "class", "once", "in_main", "bins", "tags", "mine", each.alias("each"))
    left = rows.where("NOT in_main").select("*", F.lit(False).alias("side"), F.col("mine").alias("i"), F.explode("each").alias("j")).drop("mine", "each")
    right = rows.select("*", F.lit(True).alias("side"), F.explode("each").alias("i"), F.col("mine").alias("j")).drop("mine", "each")
    found = left.unionByName(right.select(left.columns)).groupBy("key", "i", "j").applyInArrow(candidates, "block long, a array<long>, b array<long>").checkpoint()
    release(members.sparkSession)
    texts = found.select("block", F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")).join(words, "node").select("block", "node", "words")
    none = F.lit(None)
    both = found.select("block", none.cast("long").alias("node"), none.cast("binary").alias("words"), "a", "b").unionByName(texts.select("block", "node", "words", none.cast("array<long>").alias("a"), none.cast("array<long>").alias("b")))
    return both.groupBy("block").applyInArrow(verified, "a long, b long")


def _compared(pairs: DataFrame, sizes: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those similar enough."""
    pairs = _comparable(pairs, sizes, similarity)
    full = pairs.join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    return _verified(full.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").select("a", "b", "wa", "wb"), similarity)


def _comparable(pairs: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose lengths and counts of words by hash allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int64) for c in ("binsa", "binsb"))
            apart = np.maximum(np.maximum(a - b, 0).sum(axis=1), np.maximum(b - a, 0).sum(axis=1))
            longer = np.maximum(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            yield batch.filter(pa.array(apart <= np.floor((1 - similarity) * longer + 1e-9))).select(["a", "b"])

    for end in ("a", "b"):
        pairs = pairs.join(heads.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("bins").alias(f"bins{end}")), end)
    return pairs.where(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb")).mapInArrow(run, "a long, b long")


def op10_order_minhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.when(~F.col("made"), F.col("doc_id")).alias("doc_id"), "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the least id, once."""
    classes = near_duplicates(docs).where("doc_id = class_id").select(F.col("doc_id").alias("__near_id")).distinct()
    first = Window.partitionBy("__near_id").orderBy(F.xxhash64("text"))
    once = docs.withColumn("__near_id", _id()).withColumn("__near_nth", F.row_number().over(first)).where("__near_nth = 1")
    return once.join(classes, "__near_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
