"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 1 holds the first chunk
of every id, with one bit each that says whether the id goes on; level 2 holds
the second chunks of those that do, and so on. The id at position i is found by
reading chunk i, and while its bit is set going to position rank(i) of the next
level; a directory holds the rank at every 512th bit, so that an access reads at
most 8 words of the bitmap a level, wherever it is, and decodes no block.

A segment is one such code:

    magic "DAC1" | u32 ids | u32 levels | for each level: u32 chunks,
    the chunks, the bitmap as u64 words, the directory as u32

all little-endian. A token table is a Parquet table of segments, a row each, with
the documents in it, so that any filesystem Spark reaches can hold it: part and
seq give the order, local_start the ids before it in its part.

Documents are dealt by ranges of the id and sorted, so parts follow each other in
ascending order of ids. Texts are cut where byte-level pre-tokens always end; each
distinct piece is encoded by the tokenizers library once per worker, and ids are
gathered by piece. Pieces are told apart by 64-bit hashes.

Defined cases: a null text is an empty one, which still gets the end id; null ids
come last; equal ids follow a hash of the text, equal rows are the same in any order;
the string of a special token in a text becomes its id, as the library does it; a
text of any length is one row of one segment, encoded whole; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import read, shared_dir
from sparkloom.llm.textbatch import Interner, Ragged, Texts, pieces, ranges

END_ID = 2
#: Distinct pieces of text that a worker keeps, some 80 bytes each.
MOST_PIECES = 3_000_000
#: Bytes of text that are encoded in one string.
_JOIN = 16_384
_MAGIC, _BLOCK = b"DAC1", 512
_GAP, _POINT, _LETTER = (np.isin(np.arange(256), list(x)) for x in (b" \n", b".,;:!?", bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass
class Codes:
    """Levels of (chunks, bitmap words, rank directory)."""

    n: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        rest, levels = ids.astype(np.uint32), []
        while len(rest):
            chunks = (rest & np.uint32(255)).astype(np.uint8)
            rest = rest >> np.uint32(8)
            more = rest > 0
            levels.append((chunks, *cls._bitmap(more)))
            rest = rest[more]
        return cls(len(ids), levels)

    @staticmethod
    def _bitmap(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = -(-len(bits) // _BLOCK) * (_BLOCK // 64)
        packed = np.zeros(words * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        bitmap = packed.view("<u8")
        ones = np.bitwise_count(bitmap).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.uint32)
        return bitmap, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4")

    def get(self, at: np.ndarray) -> np.ndarray:
        """Ids at these positions, each found on its own."""
        at = np.asarray(at, dtype=np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("no such position")
        out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
        for shift, (chunks, bitmap, directory) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * shift)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            go = (bitmap[word] >> bit) & np.uint64(1) == 1
            live, at, word, bit = live[go], at[go], word[go], bit[go]
            if not len(live):
                break
            rank = directory[at // _BLOCK].astype(np.int64)
            first = at // _BLOCK * (_BLOCK // 64)
            for k in range(_BLOCK // 64):
                inside = first + k < word
                rank[inside] += np.bitwise_count(bitmap[first[inside] + k]).astype(np.int64)
            at = rank + np.bitwise_count(bitmap[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        return out

    def decode(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n, np.uint32)
        live = np.arange(self.n)
        for shift, (chunks, bitmap, _) in enumerate(self.levels):
            out[live] |= chunks.astype(np.uint32) << np.uint32(8 * shift)
            live = live[np.unpackbits(bitmap.view(np.uint8), bitorder="little", count=len(chunks)).view(bool)]
        return out

    def to_bytes(self) -> bytes:
        parts = [_MAGIC, struct.pack("<II", self.n, len(self.levels))]
        for chunks, bitmap, directory in self.levels:
            parts += [struct.pack("<I", len(chunks)), chunks.tobytes(), bitmap.astype("<u8").tobytes(), directory.astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Codes:
        if raw[:4] != _MAGIC:
            raise ValueError("not a segment of codes")
        n, count = struct.unpack_from("<II", raw, 4)
        at, levels = 12, []
        for _ in range(count):
            (size,) = struct.unpack_from("<I", raw, at)
            blocks = -(-size // _BLOCK)
            chunks = np.frombuffer(raw, np.uint8, size, at + 4)
            at += 4 + size
            bitmap = np.frombuffer(raw, "<u8", blocks * (_BLOCK // 64), at)
            at += 8 * len(bitmap)
            directory = np.frombuffer(raw, "<u4", blocks, at)
            at += 4 * blocks
            levels.append((chunks, bitmap, directory))
        return cls(n, levels)


class Encoder:
    """A tokenizer with the pieces of text that this worker has met."""

    def __init__(self, path: str, most: int = MOST_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        # byte-level entries have a character for each byte
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.start(most)

    def start(self, most: int) -> None:
        self.cache, self.epoch, self.found = Interner(most), -1, Ragged(np.int32)

    def ids_of(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    @staticmethod
    def cuts(texts: Texts) -> np.ndarray:
        """Flags of the first bytes of pieces: starts of texts, and places where byte-level pre-tokens always end.

        Those are a space or a line end after a character that is surely no white
        space, an ASCII character that is visible after a single line end, and one
        of .,;:!? after an ASCII letter. The end marker holds none of them.
        """
        data, first = texts.data, texts.firsts()[:-1]
        cut = first.copy()
        if len(data) > 1:
            before, now = data[:-1], data[1:]
            sure = (before > 0x20) & (before < 0x7F)
            wide = before >= 0x80
            lead = np.zeros(len(before), np.uint8)
            lead[1:] = data[:-2]
            lead2 = np.zeros(len(before), np.uint8)
            lead2[2:] = data[:-3]
            cut[1:] |= _GAP[now] & (sure | (wide & ~_odd(before, lead, lead2)))
            cut[1:] |= (before == 0x0A) & (lead > 0x20) & (lead < 0x7F) & (now > 0x20) & (now < 0x7F)
            cut[1:] |= _POINT[now] & _LETTER[before]
        return cut

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each)."""
        if not len(texts.data):
            return np.zeros(0, np.int32), np.zeros(texts.n, np.int64)
        starts = np.flatnonzero(self.cuts(texts))
        at = np.searchsorted(starts, texts.offsets)
        ends = np.append(starts[1:], len(texts.data))
        codes, fresh = self.cache.codes(Texts.span_hash(texts.prefix_hash(), starts, ends))
        if self.cache.epoch != self.epoch:
            self.epoch = self.cache.epoch
            self.found.clear()
        if len(fresh):
            self.found.extend(*self.encode_pieces(texts, starts[fresh], ends[fresh]))
        ids, sizes = self.found.gather(codes)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[at[1:]] - total[at[:-1]]


    def joinable(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces that can follow each other in any order without a token across them: a space, and then no white space at the end."""
        last = texts.data[ends - 1]
        lead = np.where(ends - starts > 1, texts.data[ends - 2], 0)
        lead2 = np.where(ends - starts > 2, texts.data[ends - 3], 0)
        return (texts.data[starts] == 0x20) & (ends - starts > 1) & (((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & ~_odd(last, lead, lead2)))

    def encode_pieces(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each).

        Joinable pieces are encoded many in one string, which is then cut by the
        tokens' bytes; should a cut not fall between tokens, the string's pieces are
        encoded one by one, as the others are.
        """
        sizes, lists = np.zeros(len(starts), np.int64), []
        join = np.flatnonzero(self.joinable(texts, starts, ends))
        alone, joined = np.ones(len(starts), bool), []
        upto = np.cumsum((ends - starts)[join])
        breaks = np.searchsorted(upto, np.arange(_JOIN, (upto[-1] if len(upto) else 0) + _JOIN, _JOIN), "right")
        groups = [g for g in np.split(join, breaks) if len(g)]
        texts_of = [texts.data[ranges(starts[g], (ends - starts)[g])].tobytes().decode("utf-8", "replace") for g in groups]
        for g, ids in zip(groups, self.ids_of(texts_of), strict=True):
            ids = np.array(ids, np.int64)
            reach = np.cumsum(self.lengths[ids])
            want = np.cumsum((ends - starts)[g])
            at = np.searchsorted(reach, want)
            if len(ids) and at[-1] == len(ids) - 1 and (reach[np.minimum(at, len(ids) - 1)] == want).all():
                sizes[g] = np.diff(np.concatenate([[-1], at]))
                joined.append(ids)
                alone[g] = False
        rest = np.flatnonzero(alone)
        if len(rest):
            lists = self.ids_of(texts.strings(starts[rest], ends[rest]))
            sizes[rest] = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.empty(int(sizes.sum()), np.int32)
        place = np.cumsum(sizes) - sizes
        flat[ranges(place[~alone], sizes[~alone])] = np.concatenate([np.zeros(0, np.int64), *joined])
        flat[ranges(place[rest], sizes[rest])] = np.fromiter(chain.from_iterable(lists), np.int32)
        return flat, sizes


def _odd(last: np.ndarray, lead: np.ndarray, lead2: np.ndarray) -> np.ndarray:
    """Whether three bytes may end in white space outside ASCII."""
    return ((lead == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((lead2 >= 0xE1) & (lead2 <= 0xE3) & ((lead == 0x80) | (lead == 0x81) | (lead == 0x9A)))


_encoders: dict[str, Encoder] = {}


def write_tokens(docs: DataFrame, where: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode all texts and write the token table in ascending order of doc_id."""
    path = path or tokenizer_path()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_id = F.col("doc_id").asc_nulls_last()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, by_id).sortWithinPartitions(by_id, F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        for batch, texts in pieces(batches):
            ids, counts = _encoders[path].encode(texts)
            # an end id after each document
            n = counts + 1
            ends = np.cumsum(n) - 1
            full = np.full(int(n.sum()), end_id, np.int32)
            inner = np.ones(len(full), dtype=bool)
            inner[ends] = False
            full[inner] = ids
            row = [[part], [seq], [start], [len(full)], [batch.column(0).to_pylist()], [n.astype(np.int32)], [Codes.encode(full).to_bytes()]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=_COLUMNS)
            seq, start = seq + 1, start + len(full)

    ordered.mapInArrow(run, "part int, seq long, local_start long, n_tokens long, doc_ids array<long>, doc_tokens array<int>, codes binary").write.option("compression", "none").parquet(where)


_COLUMNS = ["part", "seq", "local_start", "n_tokens", "doc_ids", "doc_tokens", "codes"]


def read_tokens(spark: SparkSession, where: str) -> DataFrame:
    """The token table with `base`, the ids before each part. One row for each part, as many as shuffle partitions wrote it, is broadcast."""
    table = spark.read.parquet(where)
    base, rows = 0, []
    for part, n in sorted(tuple(r) for r in table.groupBy("part").agg(F.sum("n_tokens")).collect()):
        rows.append((part, base))
        base += n
    return table.join(F.broadcast(spark.createDataFrame(rows, "part int, base long")), "part")


def tokens_at(spark: SparkSession, where: str, positions: list[int]) -> DataFrame:
    """(position, id) for positions of the whole table, one row for each position asked for.

    The part of a position is found among the parts' totals, its segment in the
    directory (part, seq, local_start, n_tokens), which is read without the codes.
    The scan of codes asks for those parts and segments only, and each id is found
    in its segment on its own, in an executor: segments lie uncompressed, and no
    block of them is decoded.
    """
    table = spark.read.parquet(where)
    totals = sorted(tuple(r) for r in table.groupBy("part").agg(F.sum("n_tokens")).collect())  # a row for each part
    ends = np.cumsum([n for _, n in totals]) if totals else np.zeros(0, np.int64)
    if positions and (not len(ends) or min(positions) < 0 or max(positions) >= ends[-1]):
        raise IndexError("no such position")
    which = np.searchsorted(ends, positions, "right").tolist()
    wanted = spark.createDataFrame([(p, totals[k][0], p - int(ends[k]) + totals[k][1]) for p, k in zip(positions, which, strict=True)], "position long, part int, at long")
    directory = table.where(F.col("part").isin({totals[k][0] for k in which})).select("part", "seq", "local_start", "n_tokens")
    inside = (F.col("at") >= F.col("local_start")) & (F.col("at") < F.col("local_start") + F.col("n_tokens"))
    hits = directory.join(F.broadcast(wanted), "part").where(inside).select("position", "part", "seq", (F.col("at") - F.col("local_start")).alias("at")).toArrow()
    segments = table.where(F.col("part").isin(set(hits["part"].to_pylist())) & F.col("seq").isin(set(hits["seq"].to_pylist()))).select("part", "seq", "codes")
    asked = spark.createDataFrame(hits.to_pylist(), "position long, part int, seq long, at long").groupBy("part", "seq").agg(F.collect_list("position").alias("positions"), F.collect_list("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for positions, at, codes in zip(*(batch.column(c) for c in ("positions", "at", "codes")), strict=True):
                ids = Codes.from_bytes(codes.as_py()).get(at.values.to_numpy())
                yield pa.RecordBatch.from_arrays([positions.values, pa.array(ids.astype(np.int64))], names=["position", "id"])

    return segments.join(F.broadcast(asked), ["part", "seq"]).select("positions", "at", "codes").mapInArrow(run, "position long, id long")


def token_at(spark: SparkSession, where: str, positions: list[int]) -> list[int]:
    """Ids at positions of the whole table, in the order asked for."""
    found = dict(map(tuple, tokens_at(spark, where, positions).collect()))
    return [found[p] for p in positions]


def document_ids(table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document, decoded from the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(batch.schema.get_field_index(c))[i] for c in ("base", "local_start", "doc_ids", "doc_tokens", "codes")}
                raw = Codes.from_bytes(row["codes"].as_py()).decode().astype("<u4").tobytes()
                n = row["doc_tokens"].values.to_numpy().astype(np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                first = row["base"].as_py() + row["local_start"].as_py()
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(first + at[:-1]), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("base", "local_start", "doc_ids", "doc_tokens", "codes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_tokens(spark, sf_dir: str) -> DataFrame:
    where = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), where)
    return document_ids(read_tokens(spark, where))
