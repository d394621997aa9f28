"""Prints, by length and kind of edit, the share of pairs at the similarity threshold that share a sketch tuple, and the members of buckets in a corpus.

    python tests/llm/measure_recall.py [documents.parquet]
"""

import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from sparkloom.llm import order_minhash as om  # noqa: E402
from sparkloom.llm.textbatch import Texts  # noqa: E402

LENGTHS = [(16, 19), (20, 24), (25, 30), (31, 39), (40, 60), (61, 99), (100, 150), (151, 300)]


def edited(rng, words, edits, even):
    n = len(words)
    places = [int((i + 0.5) * n / edits) for i in range(edits)] if even else sorted(rng.sample(range(n), edits))
    out = list(words)
    for p in places:
        out[p] = f"new{rng.randrange(10**9)}"
    return out


def recall(low, high, even, k, ell, sketches, pairs=600, seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(pairs):
        n = rng.randint(low, high)
        a = [f"w{rng.randrange(3000)}" for _ in range(n)]
        texts += [" ".join(a), " ".join(edited(rng, a, int(n * 0.2 + 1e-9), even))]
    word, at = om._words(Texts.of(texts))
    s = om.sketch(word, at, k, ell, sketches)
    return float((s[0::2] == s[1::2]).any(axis=1).mean())


def shared(texts, k, ell, sketches):
    """(rows in buckets of two texts or more, of all rows)"""
    word, at = om._words(Texts.of(texts))
    s = om.sketch(word, at, k, ell, sketches)[np.diff(at) > 0]
    _, inverse, n = np.unique(s.ravel(), return_inverse=True, return_counts=True)
    return int((n[inverse] > 1).sum()), s.size, int(n.max())


def main():
    forms = [(om.K, om.ELL, om.SKETCHES)] if len(sys.argv) < 3 else [tuple(map(int, x.split(","))) for x in sys.argv[2:]]
    for form in forms:
        print("k, ell, sketches", *form)
        for low, high in LENGTHS:
            print(f"  {low} to {high} words: even {recall(low, high, True, *form):.3f}, random places {recall(low, high, False, *form):.3f}")
        if len(sys.argv) > 1:
            import pyarrow.parquet as pq

            texts = sorted({t for t in pq.read_table(sys.argv[1])["text"].to_pylist() if t})
            print("  rows in shared buckets, all rows, largest bucket:", *shared(texts, *form))


if __name__ == "__main__":
    main()
