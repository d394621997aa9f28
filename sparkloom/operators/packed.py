"""Rows of pairs packed into pieces: a piece is one row that holds many pairs, a few bytes each, and is moved and stored as such."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.lineage import cut

#: Pairs of a piece.
PIECE = 1_000_000

_CODEC = pa.Codec("zstd", compression_level=1)
_KEPT = [("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("v", pa.binary())]


def parts_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of each id, by a hash."""
    x = ids.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)


def _small(values: np.ndarray) -> bytes:
    return _CODEC.compress(np.ascontiguousarray(values), asbytes=True)


def _large(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(data, 8 * n), kind)


def packed_row(a: np.ndarray, b: np.ndarray, v: np.ndarray | None) -> tuple:
    """Differences of the pairs in order; values that are all 1 are left out."""
    order = np.lexsort((b, a))
    v = None if v is None or (v == 1.0).all() else _small(v[order])
    return len(a), _small(np.diff(a[order], prepend=0)), _small(np.diff(b[order], prepend=0)), v


def unpacked(n: int, a: bytes, b: bytes, v: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    return np.cumsum(_large(a, n, np.int64)), np.cumsum(_large(b, n, np.int64)), None if v is None else _large(v, n, np.float64)


def rows_of(table: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    """The pairs of each piece: a, b, and values or None."""
    columns = [table.column(c) for c in ("n", "a", "b", "v")]
    for i in range(table.num_rows):
        yield unpacked(*[c[i].as_py() for c in columns])


def _batch(rows: list[tuple], names: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(names)], names=[n for n, _ in names])


def pack(pairs: DataFrame) -> DataFrame:
    """(n, a, b, v) pieces of pairs(a, b) or pairs(a, b, val), computed once. Pairs with a null are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= PIECE:
                yield made(held)
                held, n = [], 0
        if n:
            yield made(held)

    def made(held: list) -> pa.RecordBatch:
        a, b, *v = (np.concatenate(c) for c in zip(*held, strict=True))
        return _batch([packed_row(a, b, v[0] if v else None)], _KEPT)

    return cut(pairs.dropna().mapInArrow(run, "n long, a binary, b binary, v binary"))


def size(pieces: DataFrame) -> int:
    """Number of pairs."""
    return pieces.agg(F.sum("n")).first()[0] or 0


def dealt(pieces: DataFrame, parts_a: int, parts_b: int, turned: bool = False) -> DataFrame:
    """(i, j, n, a, b, v): the pieces cut by the parts of both sides, which are turned round first if asked for."""
    names = [("i", pa.int32()), ("j", pa.int32()), *_KEPT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, v in rows_of(batch):
                a, b = (b, a) if turned else (a, b)
                block = parts_of(a, parts_a) * parts_b + parts_of(b, parts_b)
                order = np.argsort(block, kind="stable")
                ends = np.cumsum(np.bincount(block, minlength=parts_a * parts_b))
                groups = [(p, order[begin:end]) for p, (begin, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if end > begin]
                yield _batch([(p // parts_b, p % parts_b, *packed_row(a[at], b[at], None if v is None else v[at])) for p, at in groups], names)

    return pieces.mapInArrow(run, "i int, j int, n long, a binary, b binary, v binary")
