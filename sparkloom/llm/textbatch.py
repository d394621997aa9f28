"""Whole Arrow batches of texts as flat numpy arrays.

Texts stay as one UTF-8 buffer; words, lines and their 64-bit hashes are found
for a whole batch at a time, without a Python object for each word. Batches are
cut to about BATCH_BYTES of text (one document at least), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at a time.
BATCH_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and every byte of a character outside ASCII.
TOKEN = np.zeros(256, dtype=bool)
TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, BATCH_BYTES + 1)
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise."""
    x = (x ^ (x >> _S33)) * _MIX_1
    x = (x ^ (x >> _S33)) * _MIX_2
    return x ^ (x >> _S33)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of start, start + 1, ... for each pair."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


class Texts:
    """`data`: UTF-8 bytes of all texts; text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets.astype(np.int64)
        self.n = len(offsets) - 1

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return cls(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw], dtype=np.int64)]).astype(np.int64))

    def firsts(self) -> np.ndarray:
        """Flags of bytes at which a text begins."""
        flags = np.zeros(len(self.data) + 1, dtype=bool)
        flags[self.offsets] = True
        return flags

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs, within a text, of bytes where `member` holds: starts, ends, and the first run of each text (with the end)."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        first = self.firsts()
        begin = member.copy()
        begin[1:] &= ~member[:-1] | first[1:-1]
        close = member.copy()
        close[:-1] &= ~member[1:] | first[1:-1]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(close) + 1, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~SPACE[self.data])

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(TOKEN[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines between newlines, empty ones too (an empty text is one empty line): starts, ends without newline, first line of each text."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        # a break at the last byte of a text begins an empty line of that text, not one of the next
        text = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, breaks, "right") - 1])
        where = np.concatenate([self.offsets[:-1], breaks + 1])
        order = np.lexsort((where, text))
        starts, text = where[order], text[order]
        at = np.searchsorted(text, np.arange(self.n + 1))
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        ends[at[1:] - 1] = self.offsets[1:]
        return starts, ends, at

    def prefix_hash(self, data: np.ndarray | None = None) -> np.ndarray:
        up, _ = _power(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data if data is None else data).astype(np.uint64) * up[: len(self.data)] + up[: len(self.data)], out=sums[1:])
        return sums

    @staticmethod
    def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes; from prefix_hash."""
        _, down = _power(len(sums))
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def strings(self, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def column(array: pa.Array) -> Texts:
    """An Arrow string column without a copy; nulls become empty texts."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    found = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[found[0] : found[-1]], found.astype(np.int64) - found[0])


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Record batches cut to about `most` bytes of text, whole rows, with the texts as arrays."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = column(batch.column(batch.schema.get_field_index(text))).offsets
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            part = batch.slice(start, end - start)
            yield part, column(part.column(part.schema.get_field_index(text)))
            start = end


class Interner:
    """Dense codes of 64-bit hashes, kept between batches of a task.

    codes(hashes) returns a code per hash; codes at and above the count of before
    are new, in order of first sight. When more than `most` are held the table is
    emptied, which costs time only.
    """

    def __init__(self, most: int = 1_500_000):
        self.most, self.epoch = most, -1
        self.reset()

    def reset(self) -> None:
        from pandas._libs.hashtable import Int64Factorizer

        self.table, self.n = Int64Factorizer(1 << 16), 0
        self.epoch += 1

    def codes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, positions of the first sight of each new code)."""
        if self.n > self.most:
            self.reset()
        before = self.n
        got = self.table.factorize(hashes.view(np.int64))
        self.n = self.table.get_count()
        fresh = np.flatnonzero(got >= before)
        first = np.full(self.n - before, len(hashes), dtype=np.int64)
        np.minimum.at(first, got[fresh] - before, fresh)
        return got, first


class Ragged:
    """Growing list of arrays of one type, kept flat, gathered by code."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.starts, self.sizes, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.n += len(sizes)

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all codes in order, number for each code)."""
        sizes = self.sizes[codes]
        return self.flat[ranges(self.starts[codes], sizes)], sizes
