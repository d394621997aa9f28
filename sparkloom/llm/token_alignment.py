"""Alignment of two tokenizers' segmentations of the same texts.

A text, with a space in front, is tokenized twice. The tokens' bytes give the byte
offsets where each segmentation ends a token; offsets where both do cut the text into
groups, the smallest spans that both sides cover with whole tokens.

The cuts are found by divide and conquer: of an interval, the common end nearest to
its middle is looked for, from the middle outwards, each end of one side by bisection
among those of the other; the interval is split there and both halves follow. An
interval without a common end inside is a leaf, one group. What was looked at without
success isn't looked at again, so that a long interval without cuts costs its length
once. All intervals of a batch of texts advance together.

Every token of one side is linked with every token of the other in its group. How many
documents of the corpus hold a pair of ids linked is counted over blocks of texts: a
block of about BLOCK_BYTES of text is one row with the distinct pairs of its documents,
and sends each distinct pair once. The counts come back to the block's row by its
number, so that no key meets more rows than there are blocks, and no block more than
its own pairs. A block is aligned in parts of PART_BYTES, which bounds a worker's memory.

Both tokenizers work on pieces of text that no token of theirs crosses, each distinct
piece once in a worker; pieces are told apart by 64-bit hashes.

Defined cases: null and empty texts, and texts that either side doesn't give back byte
by byte, have no tokens, groups or links; strings of special tokens in a text are plain
text; repeated rows are documents of their own; a null id stays null; a text of any
length is aligned whole, in a block of its own if it is long; ids tie for the highest
count together; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import pieces as piece_model
from sparkloom.llm import token_codes
from sparkloom.llm.common import read, shared_dir
from sparkloom.llm.textbatch import Ragged, Texts, pieces, ranges

#: Text bytes of a block.
BLOCK_BYTES = 2_000_000
#: Text bytes of a block that are aligned at a time.
PART_BYTES = 500_000
#: Distinct pieces of text that a worker keeps for each side, some 100 bytes each.
MOST_PIECES = 300_000
#: Pairs of ids that are listed at a time, when groups of many tokens are linked.
MOST_PAIRS = 4_000_000


class ByteLevel(token_codes.Encoder):
    """A byte-level BPE; special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path, MOST_PIECES)
        self.tokenizer.encode_special_tokens = True
        # byte-level alphabets write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        tokens = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.tokenizer.get_vocab().items()}
        self.bodies = _table([tokens.get(i, b"") for i in range(max(tokens) + 1)])


class Sentence(token_codes.Encoder):
    """A SentencePiece model with an identity normaliser. The space in front is given with the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(Path(path).read_bytes())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("the model changes texts before it segments them")
        proto.normalizer_spec.add_dummy_prefix = False
        self.processor = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.start(MOST_PIECES)
        mark, bodies = piece_model.SPACE_MARK, []
        # bytes that follow each other inside a piece: texts can be cut elsewhere
        self.joined = np.zeros((256, 256), dtype=bool)
        for p in proto.pieces:
            body = bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(mark, " ").encode() if p.type in (1, 4, 5) else b""
            bodies.append(body)
            raw = np.frombuffer(body, np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        # nor between the bytes of a character
        self.joined[:, 0x80:0xC0] = True
        self.bodies = _table(bodies)
        self.lengths = self.bodies.sizes[: self.bodies.n].copy()

    def joinable(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """No token goes on with a space; the mark of spaces, as a character of a text, has a token of another length."""
        marks = np.concatenate([[0], np.cumsum(texts.data == 0xE2)])
        return (texts.data[starts] == 0x20) & (texts.data[ends - 1] != 0x20) & (marks[ends] == marks[starts])

    def cuts(self, texts: Texts) -> np.ndarray:
        cut = texts.firsts()[:-1]
        cut[1:] |= ~self.joined[texts.data[:-1], texts.data[1:]]
        return cut

    def ids_of(self, strings: list[str]) -> list[list[int]]:
        return self.processor.encode(strings, num_threads=1)


def _table(bodies: list[bytes]) -> Ragged:
    out = Ragged(np.uint8)
    out.extend(np.frombuffer(b"".join(bodies), np.uint8), np.array([len(b) for b in bodies], np.int64))
    return out


def _sums(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def spaced(texts: Texts) -> Texts:
    """The texts with a space in front; empty ones stay empty."""
    some = np.diff(texts.offsets) > 0
    return Texts(np.insert(texts.data, texts.offsets[:-1][some], 0x20), texts.offsets + _sums(some))


def given_back(texts: Texts, ids: np.ndarray, counts: np.ndarray, bodies: Ragged) -> np.ndarray:
    """Which texts the tokens' bytes spell."""
    flat, sizes = bodies.gather(ids)
    at = _sums(sizes)[_sums(counts)]
    length = np.diff(texts.offsets)
    same = np.diff(at) == length
    mine, theirs = ranges(at[:-1][same], length[same]), ranges(texts.offsets[:-1][same], length[same])
    wrong = np.flatnonzero(flat[mine] != texts.data[theirs])
    same[np.flatnonzero(same)[np.searchsorted(_sums(length[same]), wrong, "right") - 1]] = False
    return same


def shared_cuts(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Positions in `a` of all ends that are in `b` too, among those at low[i] .. high[i] - 1 of each interval i. Both are ascending.

    Divide and conquer: the middle of each interval is looked at, then the ends at one
    more place to the left and to the right of it, until one is shared.
    """

    def shared(at: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(b, a[at]), len(b) - 1)
        return b[place] == a[at]

    found, reach = [], np.zeros(len(low), np.int64)
    while len(low):
        live = low < high
        low, high, reach = low[live], high[live], reach[live]
        middle = (low + high - 1) // 2
        left, right = middle - reach, middle + reach
        hit = np.zeros(len(low), bool)
        some = np.flatnonzero(left >= low)
        hit[some] = shared(left[some])
        cut, after = left.copy(), np.where(reach > 0, right, left + 1)
        some = np.flatnonzero(~hit & (reach > 0) & (right < high))
        late = some[shared(right[some])]
        hit[late], cut[late], after[late] = True, right[late], right[late] + 1
        found.append(cut[hit])
        # nothing between the places looked at is shared: the halves are what lies beyond them, in order of place; other intervals look further
        on = ~hit & ((left > low) | (right < high - 1))
        size = on + 2 * hit
        at = np.cumsum(size) - size
        total = int(size.sum())
        was = low, high, reach
        low, high, reach = np.empty(total, np.int64), np.empty(total, np.int64), np.zeros(total, np.int64)
        low[at[on]], high[at[on]], reach[at[on]] = was[0][on], was[1][on], was[2][on] + 1
        low[at[hit]], high[at[hit]] = was[0][hit], np.maximum(left[hit], was[0][hit])
        low[at[hit] + 1], high[at[hit] + 1] = after[hit], was[1][hit]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass
class Aligned:
    """Tokens of both sides of a batch of texts, the number of each text's tokens and groups, and the first token of each group (with the end)."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: Texts, left: token_codes.Encoder, right: token_codes.Encoder) -> Aligned:
        """The texts have their space in front."""
        sides = []
        for encoder in (left, right):
            ids, counts = encoder.encode(texts)
            sides.append((ids.astype(np.int64), counts))
        good = (np.diff(texts.offsets) > 0) & given_back(texts, *sides[0], left.bodies) & given_back(texts, *sides[1], right.bodies)
        kept = [(ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in sides]
        (a, n_a), (b, n_b) = kept
        ends_a, ends_b = (np.cumsum(x.sizes[i]) for x, i in ((left.bodies, a), (right.bodies, b)))
        some = n_a > 0
        last = np.cumsum(n_a)[some]
        inner = shared_cuts(ends_a, ends_b, last - n_a[some], last - 1)
        cuts = np.sort(np.concatenate([inner, last - 1]))
        first_a, first_b = _sums(np.diff(np.concatenate([[0], cuts + 1]))), np.concatenate([[0], np.searchsorted(ends_b, ends_a[cuts]) + 1])
        n_groups = np.diff(np.searchsorted(cuts, _sums(n_a)))
        starts = np.repeat(_sums(np.diff(texts.offsets) * good)[:-1], n_groups)
        return cls(a, b, n_a, n_b, n_groups, first_a, first_b, ends_a[cuts] - starts)

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as a1,a2|b1;a3|b2,b3 in decimal ids; empty without tokens."""
        size_a, size_b = np.diff(self.first_a), np.diff(self.first_b)
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        at_a = np.arange(len(self.a)) + np.repeat(self.first_b[:-1], size_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.first_a[1:], size_b)
        ids[at_a], ids[at_b] = self.a, self.b
        flat, sizes = _decimals(int(ids.max(initial=0)).bit_length()).gather(ids)
        flat, end = flat.copy(), np.cumsum(sizes)
        bars = at_a[self.first_a[1:] - 1]
        breaks = at_b[self.first_b[1:] - 1]
        flat[end[bars] - 1], flat[end[breaks] - 1] = ord("|"), ord(";")
        raw, stop = flat.tobytes(), np.concatenate([[0], end])[_sums(self.n_a + self.n_b)]
        return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, a << 32 | b, how often) of all linked pairs, one row for each pair of distinct ids of a group."""
        group = [np.repeat(np.arange(len(f) - 1), np.diff(f)) for f in (self.first_a, self.first_b)]
        owner = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        sides = []
        for g, ids in zip(group, (self.a, self.b), strict=True):
            key = g << 32 | ids
            # most groups have one token of a side, and keys in order already
            key, n = (key, np.ones(len(key), np.int64)) if len(key) < 2 or (np.diff(key) > 0).all() else np.unique(key, return_counts=True)
            sides.append((key & 0xFFFFFFFF, n, _sums(np.bincount(key >> 32, minlength=len(owner)))))
        (ids_a, times_a, at_a), (ids_b, times_b, at_b) = sides
        size_a, size_b = np.diff(at_a), np.diff(at_b)
        out = []
        total, low = np.cumsum(size_a * size_b), 0
        while low < len(owner):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + MOST_PAIRS, "right")))
            mine = np.arange(at_a[low], at_a[high])
            g = np.repeat(np.arange(low, high), size_a[low:high])
            i, j = np.repeat(mine, size_b[g]), ranges(at_b[g], size_b[g])
            out.append((owner[np.repeat(g, size_b[g])], ids_a[i] << 32 | ids_b[j], times_a[i] * times_b[j]))
            low = high
        return tuple(np.concatenate([np.zeros(0, np.int64), *[x[k] for x in out]]) for k in range(3))


@cache
def _decimals(bits: int) -> Ragged:
    """Ids below 2^bits in decimal with a comma."""
    return _table([b"%d," % i for i in range(1 << bits)])


_encoders: dict[tuple, tuple] = {}


def encoders(byte_path: str, piece_path: str) -> tuple[ByteLevel, Sentence]:
    """This worker's encoders for two vocabulary files."""
    if (byte_path, piece_path) not in _encoders:
        _encoders[byte_path, piece_path] = ByteLevel(byte_path), Sentence(piece_path)
    return _encoders[byte_path, piece_path]


def _paths(byte_path: str | None, piece_path: str | None) -> tuple[str, str]:
    return byte_path or token_codes.tokenizer_path(), piece_path or piece_model.model_path()


def aligned_groups(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """(doc_id, groups) for each row: byte spans of the text with its space in front, and the ids on either side."""
    where = _paths(byte_path, piece_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            x = Aligned.of(spaced(texts), *encoders(*where))
            first = np.concatenate([[0], x.ends[:-1]])
            first[_sums(x.n_groups)[:-1][x.n_groups > 0]] = 0
            ids = [pa.ListArray.from_arrays(pa.array(f, pa.int32()), pa.array(v, pa.int32())) for f, v in ((x.first_a, x.a), (x.first_b, x.b))]
            spans = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(x.ends, pa.int64()), *ids], names=["start", "end", "a", "b"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(_sums(x.n_groups), pa.int32()), spans)], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>")


def _part(texts: Texts, where: tuple[str, str]) -> tuple:
    """Figures of each text, then the distinct linked pairs of one text after the other and how often each is linked, then digests."""
    x = Aligned.of(spaced(texts), *encoders(*where))
    text, code, times = x.links()
    n_links = np.zeros(texts.n, np.int64)
    np.add.at(n_links, text, times)
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(text) > 0) | (np.diff(code) != 0)])) if len(code) else np.zeros(0, np.int64)
    sums = np.add.reduceat(times[order], begin) if len(begin) else begin
    return x.n_a, x.n_b, x.n_groups, n_links, np.bincount(text[begin], minlength=texts.n), code[begin], sums, x.digests()


_BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_pairs array<long>, pair array<int>, times array<long>, code array<long>, docs array<long>"


def block_rows(batches: Iterator[pa.RecordBatch], where: tuple[str, str], number: int) -> Iterator[pa.RecordBatch]:
    """The rows of `aligned_blocks` for (doc_id, text) batches, numbered from `number` on."""
    for batch, _ in pieces(batches, most=BLOCK_BYTES):
        parts = [_part(texts, where) for _, texts in pieces(iter([batch]), most=PART_BYTES)]
        n_a, n_b, n_groups, n_links, n_pairs, code, times = (np.concatenate([x[k] for x in parts]) for k in range(7))
        digests = [d for x in parts for d in x[7]]
        distinct, pair = np.unique(code, return_inverse=True)
        row = [[number], [batch.column(0).to_pylist()], [n_a], [n_b], [n_groups], [n_links], [digests], [n_pairs], [pair.astype(np.int32)], [times], [distinct], [np.bincount(pair, minlength=len(distinct))]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)
        number += 1


def aligned_blocks(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """A row for each block: its documents' figures, their distinct linked pairs as places (`pair`) in the block's list of distinct `code`s, with multiplicities, and the number of its documents that hold each code."""
    where = _paths(byte_path, piece_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return block_rows(batches, where, TaskContext.get().partitionId() << 33)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]
_TYPES = [pa.int64() if x.endswith(" long") else pa.list_({"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split("<")[1][:-1]]) for x in _BLOCK.split(", ")]


def scored_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of the documents of all blocks."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip("code", "docs")).alias("place", "x")).select(F.col("block").alias("part"), "place", "x.code", "x.docs")
    counts = rows.groupBy("code").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("code", 32)).checkpoint()
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    known = counts.join(highest, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    found = rows.select("part", "place", "code").join(known, "code").select("part", "place", "n", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = {c: left.column(c).combine_chunks().flatten() for c in _NAMES[1:10]}
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        at = right.column("place").to_numpy()
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
        pair, times = block["pair"].to_numpy(), block["times"].to_numpy()
        own = np.repeat(np.arange(len(block["n_a"])), block["n_pairs"].to_numpy())
        sums = [np.zeros(len(block["n_a"]), np.int64) for _ in range(2)]
        np.add.at(sums[0], own, times * best[pair])
        np.add.at(sums[1], own, times * n[pair])
        out = {c: block[c] for c in _NAMES[1:6]} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": block["groups_sha256"]}
        return pa.table(out)

    slim = blocks.drop("code", "docs")
    return slim.groupBy("block").cogroup(found.groupBy("part")).applyInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def token_alignment(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """The figures of `scored_documents` for each row of `docs`."""
    shared_dir(docs.sparkSession)
    return scored_documents(aligned_blocks(docs, byte_path, piece_path).checkpoint())


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return token_alignment(read(spark, sf_dir, "documents"))
