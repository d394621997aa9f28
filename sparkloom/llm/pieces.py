"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Text is escaped as the model's normaliser asks (a space in front, spaces as
U+2581) and cut where a space follows another character, which no piece crosses.
The best segmentation of each distinct word is found once per task: words of
equal length advance together; substring hashes probe the sorted piece keys; the
scores of all words' best prefixes are matrices, and vectorised maxima store the
backpointers. Equal scores keep the longer last piece. Characters that no piece
covers become the bytes of their UTF-8 form.

The vocabulary's own kind is not asked for: its scores are ranks of merges, and
the segmentation is the one of highest total score, not a replay of merges.

Defined cases: null and empty texts have no ids; U+2581 in a text decodes to a
space (the escape is not injective); repeated rows encode alike; equal scores keep the
longer last piece; a very long text is encoded whole, a batch of its own; an empty table
gives an empty result; columns asked for are passed on, and those that begin with
__ids, __pieces or __round_trip are reserved (`stage` names its own piece_ids, n_pieces
and round_trip).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from sparkloom.llm.common import read
from sparkloom.llm.lattice import PieceTable, code_points, edges_by_end
from sparkloom.llm.textbatch import Interner, Ragged, Texts, pieces

SPACE_MARK = "▁"
_MARK = SPACE_MARK.encode()
#: How much worse than the worst piece an uncovered character is.
UNKNOWN_PENALTY = 10.0
#: Distinct words that a worker keeps between tasks, some 120 bytes each.
MOST_WORDS = 500_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """Encoder and decoder for a SentencePiece model file with byte fallback."""

    path: str

    def __post_init__(self) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(Path(self.path).read_bytes())
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        self.ids = np.array([i for i, _, _ in normal], dtype=np.int32)
        self.scores = np.array([s for _, _, s in normal])
        self.table = PieceTable([p for _, p, _ in normal])
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for _, p, _ in normal):
            raise ValueError("a piece crosses words")
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        if len(byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.byte_ids = np.array([byte[b] for b in range(256)], dtype=np.int32)
        bodies: list[bytes] = [b""] * len(proto.pieces)
        for i, p, _ in normal:
            bodies[i] = p.encode()
        for b, i in byte.items():
            bodies[i] = bytes([b])
        self.bodies = Ragged(np.uint8)
        self.bodies.extend(np.frombuffer(b"".join(bodies), np.uint8), np.array([len(b) for b in bodies], np.int64))
        self.cache, self.epoch = Interner(MOST_WORDS), -1
        self.found = Ragged(np.int32)

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has."""
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        for where, points in code_points(words):
            step = max(1, 200_000 // max(1, points.shape[1]))
            for i in range(0, len(where), step):
                for w, ids in zip(where[i : i + step].tolist(), self._viterbi(points[i : i + step], [words[j] for j in where[i : i + step].tolist()]), strict=True):
                    done[w] = ids
        sizes = np.fromiter(map(len, done), np.int64, len(done))
        return (np.concatenate(done) if done else np.zeros(0, np.int32)), sizes

    def _viterbi(self, points: np.ndarray, words: list[str]) -> list[np.ndarray]:
        rows, length = points.shape
        if not length:
            return [np.zeros(0, np.int32)] * rows
        edges = edges_by_end(self.table, points)
        covered = np.zeros((rows, length), dtype=bool)
        for end, into in enumerate(edges):
            if into and into[0][0] == 1:
                covered[into[0][1], end - 1] = True
        best = np.full((rows, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((rows, length + 1), np.int16)
        piece = np.full((rows, length + 1), -1, np.int32)
        for end in range(1, length + 1):
            bare = np.flatnonzero(~covered[:, end - 1])
            # earlier starts first: only a better score replaces, so the longest piece wins a tie
            for size, row, number in reversed(edges[end]):
                if size == 1:
                    continue
                self._relax(best, back, piece, row, end, size, best[row, end - size] + self.scores[number], number)
            if len(bare):
                self._relax(best, back, piece, bare, end, 1, best[bare, end - 1] + self.unknown, np.full(len(bare), -1))
            for size, row, number in edges[end][:1]:
                if size == 1:
                    self._relax(best, back, piece, row, end, 1, best[row, end - 1] + self.scores[number], number)
        # follow the backpointers of all words together, from their ends
        cur = np.full(rows, length)
        columns = []
        while (cur > 0).any():
            live = cur > 0
            r = np.arange(rows)
            columns.append(np.where(live, piece[r, cur], -2))
            cur = np.where(live, cur - back[r, cur], 0)
        numbers = np.stack(columns[::-1], axis=1)
        bytewise = (numbers == -1).any(axis=1)
        used = numbers >= 0
        flat = self.ids[numbers[used]]
        out = np.split(flat, np.cumsum(used.sum(axis=1))[:-1])
        for w in np.flatnonzero(bytewise).tolist():
            ids, at = [], 0
            for number in numbers[w][numbers[w] != -2].tolist():
                if number >= 0:
                    ids.append(int(self.ids[number]))
                    at += len(self.table.pieces[number])
                else:
                    ids.extend(self.byte_ids[list(words[w][at].encode("utf-8", "replace"))].tolist())
                    at += 1
            out[w] = np.array(ids, np.int32)
        return out

    @staticmethod
    def _relax(best, back, piece, row, end, size, score, number) -> None:
        better = score > best[row, end]
        row = row[better]
        best[row, end] = score[better]
        back[row, end] = size
        piece[row, end] = number[better]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each)."""
        if not len(texts.data):
            return np.zeros(0, np.int32), np.zeros(texts.n, np.int64)
        # a word begins at a text's first byte and at a space after another character
        space = texts.data == 0x20
        first = texts.firsts()[:-1]
        begin = first.copy()
        begin[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(begin)
        at = np.searchsorted(starts, texts.offsets)
        ends = np.append(starts[1:], len(texts.data))
        sums = texts.prefix_hash()
        hashes = Texts.span_hash(sums, starts, ends) ^ (first[starts].astype(np.uint64) * np.uint64(0x5BD1E995))
        codes, fresh = self.cache.codes(hashes)
        if self.cache.epoch != self.epoch:
            self.epoch = self.cache.epoch
            self.found.clear()
        if len(fresh):
            raw = texts.data.tobytes()
            words = [(" " if first[starts[i]] else "") + raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in fresh.tolist()]
            self.found.extend(*self.segment([w.replace(" ", SPACE_MARK) for w in words]))
        ids, sizes = self.found.gather(codes)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[at[1:]] - total[at[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text, without the space in front."""
        flat, sizes = self.bodies.gather(ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        raw = flat.tobytes()
        out = [raw[a:b].replace(_MARK, b" ") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return [x[1:] if x[:1] == b" " else x for x in out]


_coders: dict[str, Pieces] = {}


def coder(path: str) -> Pieces:
    """The worker process's coder for a model, with the words that it has met."""
    if path not in _coders:
        _coders[path] = Pieces(path)
    return _coders[path]


def encode(docs: DataFrame, keep: list[str], path: str | None = None, ids: bool = False) -> DataFrame:
    """Columns `keep` of `docs`, with __pieces (number of ids), __crc32 (of the ids as little-endian unsigned 32-bit integers), __round_trip (decoding gives the text) and, if asked, __ids."""
    path = path or model_path()
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    inputs = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))
    extra = [StructField("__pieces", LongType()), StructField("__crc32", LongType()), StructField("__round_trip", BooleanType())]
    if ids:
        from pyspark.sql.types import ArrayType, IntegerType

        extra.append(StructField("__ids", ArrayType(IntegerType())))
    schema = StructType([*kept.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch, texts in pieces(batches):
            found, counts = own.encode(texts)
            at = np.concatenate([[0], np.cumsum(counts)])
            raw, source = found.astype("<u4").tobytes(), texts.data.tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            back = own.decode(found, counts)
            same = [x == source[a:b].replace(_MARK, b" ") for x, a, b in zip(back, texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]
            if ids:
                made.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found)))
            yield pa.RecordBatch.from_arrays([*cols, *made], names=[*keep, *[f.name for f in extra]])

    return inputs.mapInArrow(run, schema)


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", F.col("__pieces").alias("n_pieces"), F.col("__crc32").alias("ids_crc32"), F.col("__round_trip").alias("round_trip"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: every row with its piece ids."""
    out = encode(docs, docs.columns, ids=True)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("__ids").alias("piece_ids"), F.col("__pieces").alias("n_pieces"), F.col("__round_trip").alias("round_trip"))
