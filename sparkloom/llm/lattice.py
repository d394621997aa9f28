"""Substring pieces of many words at once: hashes probe sorted piece keys.

Words are rows of a matrix of code points, all of one length. The hash of every
substring follows from that of the substring one shorter, for all words and
starts at a time; a bit table sieves out most that are no piece, and a binary
search in the sorted keys settles the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from sparkloom.llm.textbatch import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def code_points(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words by length: (positions in `words`, matrix of code points)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    flat = np.frombuffer("".join([words[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, at, i = [], 0, 0
    lengths, counts = np.unique(sizes, return_counts=True)
    for length, count in zip(lengths.tolist(), counts.tolist(), strict=True):
        out.append((order[i : i + count], flat[at : at + count * length].reshape(count, length)))
        i, at = i + count, at + count * length
    return out


@dataclass
class PieceTable:
    """Pieces with dense numbers 0, 1, ...; `find` gives the number of each substring, -1 where there is none."""

    pieces: list[str]
    longest: int = 0
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=0)
        keys = np.zeros(len(self.pieces), np.uint64)
        for where, points in code_points(self.pieces):
            h = np.zeros(len(where), np.uint64)
            for j in range(points.shape[1]):
                h = (h + points[:, j]) * _STEP + np.uint64(1)
            keys[where] = mix(h)
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], order
        if len(np.unique(keys)) != len(keys):
            raise ValueError("pieces are repeated")
        self.sieve = np.zeros(1 << _BITS, dtype=bool)
        self.sieve[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece length: (length, rows, starts, piece numbers) of all substrings that are pieces."""
        rows, length = points.shape
        h = np.zeros((rows, length), np.uint64)
        wide = points.astype(np.uint64)
        for size in range(1, min(self.longest, length) + 1):
            last = length - size + 1
            h = (h[:, :last] + wide[:, size - 1 :]) * _STEP + np.uint64(1)
            key = mix(h)
            maybe = np.flatnonzero(self.sieve[(key >> np.uint64(64 - _BITS)).astype(np.int64)].ravel())
            want = key.ravel()[maybe]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            where = maybe[hit]
            yield size, where // last, where % last, self.numbers[at[hit]]


def edges_by_end(table: PieceTable, points: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each end position the pieces that end there, by rising length: (length, rows, piece numbers)."""
    _, length = points.shape
    edges: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(length + 1)]
    for size, row, start, number in table.find(points):
        order = np.argsort(start, kind="stable")
        row, start, number = row[order], start[order], number[order]
        cuts = np.searchsorted(start, np.arange(length - size + 2))
        for s in range(length - size + 1):
            if cuts[s] < cuts[s + 1]:
                edges[s + size].append((size, row[cuts[s] : cuts[s + 1]], number[cuts[s] : cuts[s + 1]]))
    return edges
