"""Document quality from line labels of a linear-chain conditional random field.

Each line is good or bad. Its features (shares of symbols, capitals, digits and
punctuation, repeated words, lengths, line ends, repeats of earlier lines) and
those of the lines before and after it give its potential; a 2 x 2 matrix couples
neighbouring labels. A document's quality is the mean of its lines' marginal
probabilities of being good, from forward-backward, weighted by length; a
logistic curve fitted to the training documents maps it to a score in [0, 1].

Only documents are labelled, so lines are first labelled like their document;
then lines of bad documents that the first model finds good are relabelled (as
long as a bad line remains) and the field is fitted again.

Defined cases: null and empty texts are one empty line; lines of no bytes weigh
as one byte; repeated rows score alike; lines with equal potentials have equal
marginals up to their neighbours'; texts of any length are scored whole, in time linear
in bytes and lines; a sample without both classes gives the constant score of its base
rate (1 if there is none, so that nothing is lost); an empty table gives an empty
result; other columns pass through `score` and `stage` whatever their names, except
those beginning with __.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from sparkloom.llm.common import fitted, held_out, labelled_sample, read
from sparkloom.llm.textbatch import Texts, pieces

THRESHOLD = 0.3
#: Bounds of the sample that the field is fitted on: documents, and lines in all; TRAIN_CHARS of `common` bounds its characters.
TRAIN_ROWS, TRAIN_LINES = 4_000, 400_000
SEED, SPLIT = 2, (5, 0)
STEPS, RATE, RIDGE = 60, 0.15, 1e-3

_CLASSES = {
    "symbol": b"#*$%&|<>{}[]\\^~=+@_",
    "pipe": b"|",
    "shout": b"!?",
    "upper": bytes(range(0x41, 0x5B)),
    "lower": bytes(range(0x61, 0x7B)),
    "digit": b"0123456789",
    "point": b".,;:",
    "other": b"\"'()-/`",
    "high": bytes(range(0x80, 0x100)),
}
_TABLE = np.zeros((len(_CLASSES), 256), dtype=bool)
for _i, _members in enumerate(_CLASSES.values()):
    _TABLE[_i, list(_members)] = True
_END = np.zeros(256, dtype=bool)
_END[list(b".!?\"':;)")] = True


def line_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines with their neighbours', byte lengths, first line of each text)."""
    starts, ends, at = texts.lines()
    length = ends - starts
    safe = np.maximum(length, 1)
    cols = []
    sums = np.zeros(len(texts.data) + 1, dtype=np.int32)
    counts = {}
    for name, row in zip(_CLASSES, _TABLE, strict=True):
        np.cumsum(row[texts.data], out=sums[1:])
        counts[name] = (sums[ends] - sums[starts]).astype(np.float64)
        cols.append(counts[name] / safe)
    cols.append(counts["upper"] / np.maximum(counts["upper"] + counts["lower"], 1))
    w_start, w_end, _ = texts.words()
    bounds = np.searchsorted(w_start, np.concatenate([starts, [len(texts.data)]]))
    first, last = bounds[:-1], np.searchsorted(w_start, ends)
    n_words = last - first
    hashes = Texts.span_hash(texts.prefix_hash(), w_start, w_end)
    same = np.zeros(len(w_start) + 1, dtype=np.int32)
    if len(w_start) > 1:
        same[2:] = np.cumsum(hashes[1:] == hashes[:-1])
    # equal neighbours within the line: the pair that crosses its first word doesn't count
    repeats = np.where(n_words > 1, same[last] - same[np.minimum(first + 1, len(w_start))], 0)
    cols.append(repeats / np.maximum(n_words - 1, 1))
    cols.append(np.minimum(np.log1p(length) / 6, 2.0))
    cols.append(np.minimum(length / np.maximum(n_words, 1) / 10, 3.0))
    cols.append(np.where(length > 0, _END[texts.data[np.maximum(ends - 1, 0)]] if len(texts.data) else 0, 0))
    cols.append(length == 0)
    line_hash = Texts.span_hash(texts.prefix_hash(), starts, ends)
    doc = np.repeat(np.arange(texts.n), np.diff(at))
    order = np.lexsort((np.arange(len(line_hash)), line_hash, doc))
    earlier = np.zeros(len(order), dtype=bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        earlier[b] = (line_hash[a] == line_hash[b]) & (doc[a] == doc[b])
    cols.append(earlier & (length > 0))
    own = np.column_stack([np.asarray(c, dtype=np.float64) for c in cols])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[at[:-1]] = 0
    after[at[1:] - 1] = 0
    edge = np.zeros((len(own), 2))
    edge[at[:-1], 0] = edge[at[1:] - 1, 1] = 1
    return np.hstack([own, before, after, edge]), np.maximum(length, 1), at


def _steps(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling number of lines, and how many have a line at each position."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    return order, np.searchsorted(-n[order], -np.arange(1, int(n.max(initial=0)) + 1), "right")


def forward_backward(unary: np.ndarray, at: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-marginals for labels (bad 0, good 1) with potentials (0, unary) and `trans`: P(good) of each line, expected label pairs, sum of log Z.

    All texts advance together, line by line.
    """
    order, active = _steps(at)
    base = at[:-1][order]
    n = np.diff(at)[order]
    alpha, beta = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    alpha[:, 1] = unary
    for t in range(1, len(active)):
        k = base[: active[t]] + t
        prev = alpha[k - 1]
        alpha[k] += np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
    for t in range(len(active) - 2, -1, -1):
        k = base[: active[t + 1]] + t
        nxt = beta[k + 1]
        up = np.stack([nxt[:, 0], nxt[:, 1] + unary[k + 1]], axis=1)
        beta[k] = np.stack([np.logaddexp(up[:, 0] + trans[0, 0], up[:, 1] + trans[0, 1]), np.logaddexp(up[:, 0] + trans[1, 0], up[:, 1] + trans[1, 1])], axis=1)
    z = np.empty(len(n))
    z[:] = np.logaddexp(*alpha[base + n - 1].T)
    logz = np.empty(len(n))
    logz[order] = z
    per_line = np.repeat(logz, np.diff(at))
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - per_line, 0.0))
    has_next = np.ones(len(unary), dtype=bool)
    has_next[at[1:] - 1] = False
    i = np.flatnonzero(has_next)
    pair = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pair[a, b] = np.exp(alpha[i, a] + trans[a, b] + beta[i + 1, b] + (unary[i + 1] if b else 0.0) - per_line[i]).sum()
    return good, pair, float(z.sum())


@dataclass
class QualityModel:
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    trans: np.ndarray | None = None
    slope: float = 0.0
    intercept: float = 0.0
    constant: float | None = None

    def line_marginals(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, length, at = line_features(texts)
        good, _, _ = forward_backward(((x - self.mean) / self.scale) @ self.weights + self.bias, at, self.trans)
        return good, length, at

    def quality(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean marginal of each text, and its number of bad lines."""
        if self.constant is not None:
            return np.full(texts.n, self.constant), np.zeros(texts.n, np.int64)
        good, length, at = self.line_marginals(texts)
        weight = np.add.reduceat(length, at[:-1]) if texts.n else np.zeros(0)
        return np.add.reduceat(good * length, at[:-1]) / weight, np.add.reduceat((good < 0.5).astype(np.int64), at[:-1])

    def score(self, quality: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return quality
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * quality + self.intercept, -50, 50)))


def _fit_field(x: np.ndarray, at: np.ndarray, y: np.ndarray, model: QualityModel) -> None:
    """Adam on the mean log-likelihood of the line labels."""
    n = len(x)
    inside = np.ones(n, dtype=bool)
    inside[at[1:] - 1] = False
    i = np.flatnonzero(inside)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i].astype(int), y[i + 1].astype(int)), 1)
    theta = np.concatenate([model.weights, [model.bias], model.trans.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    f = x.shape[1]
    for step in range(1, STEPS + 1):
        good, pair, _ = forward_backward(x @ theta[:f] + theta[f], at, theta[f + 1 :].reshape(2, 2))
        err = y - good
        grad = np.concatenate([x.T @ err / n - RIDGE * theta[:f], [err.mean()], (seen - pair).ravel() / n - RIDGE * theta[f + 1 :]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.bias, model.trans = theta[:f], float(theta[f]), theta[f + 1 :].reshape(2, 2)


def fit(texts: list[str], labels: np.ndarray) -> QualityModel:
    """Fit on a bounded sample held in memory; it ends early at TRAIN_LINES lines."""
    labels = np.asarray(labels, dtype=np.int64)
    parts, used, lines = [], 0, 0
    for i in range(0, len(texts), 250):
        parts.append(line_features(Texts.of(texts[i : i + 250])))
        used, lines = min(i + 250, len(texts)), lines + len(parts[-1][0])
        if lines >= TRAIN_LINES:
            break
    labels = labels[:used]
    if not used or labels.min() == labels.max():
        return QualityModel(constant=float(labels.mean()) if used else 1.0)
    x = np.vstack([p[0] for p in parts])
    length = np.concatenate([p[1] for p in parts])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    model = QualityModel(mean=x.mean(0), scale=x.std(0) + 1e-6, weights=np.zeros(x.shape[1]), trans=np.zeros((2, 2)))
    x = (x - model.mean) / model.scale
    y = np.repeat(labels, np.diff(at)).astype(np.float64)
    _fit_field(x, at, y, model)
    good, _, _ = forward_backward(x @ model.weights + model.bias, at, model.trans)
    lift = (y == 0) & (good > 0.5)
    worst = np.minimum.reduceat(good, at[:-1])
    lift &= np.repeat(worst < 0.5, np.diff(at))
    y[lift] = 1
    _fit_field(x, at, y, model)
    good, _, _ = forward_backward(x @ model.weights + model.bias, at, model.trans)
    quality = np.add.reduceat(good * length, at[:-1]) / np.add.reduceat(length, at[:-1])
    model.slope, model.intercept = logistic(quality, labels)
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve in one input by damped Newton steps, slope at least 0."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        w = p * (1 - p) + 1e-6
        g = np.array([(x * (y - p)).sum() - 0.05 * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    def run(sample: pa.Table) -> QualityModel:
        if not sample.num_rows:
            return fit([], np.zeros(0))
        # fit() may end early, so the order is that of the seeded hash
        order = np.lexsort((sample["__id"].to_numpy(), sample["__turn"].to_numpy()))
        return fit(sample["text"].take(order).to_pylist(), sample["y"].to_numpy()[order])

    return fitted(labelled_sample(docs, labels, "quality", *SPLIT, rows, SEED).withColumn("__turn", F.xxhash64(F.lit(SEED), "__id")), run)


def score(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs`, with __score, __quality and __bad_lines of the column text."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    inputs = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))
    schema = StructType([*kept.schema.fields, StructField("__score", DoubleType()), StructField("__quality", DoubleType()), StructField("__bad_lines", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            quality, bad = model.quality(texts)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(model.score(quality)), pa.array(quality), pa.array(bad)], names=[*keep, "__score", "__quality", "__bad_lines"])

    return inputs.mapInArrow(run, schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), *SPLIT).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"), F.col("__bad_lines").alias("bad_lines"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of good quality."""
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model, docs.columns).where(F.col("__score") >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
