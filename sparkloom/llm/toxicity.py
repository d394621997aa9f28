"""Toxic passages by maximum-scoring segment search.

Tokens (runs of letters and digits, ASCII letters folded) score by their
log-odds between toxic and other training documents under an informative
Dirichlet prior, whose pseudo-counts follow the whole sample. A word without a
significant score of its own backs off to its beginning of 8, 7, 6 or 5 bytes.
All other tokens score a small negative log-likelihood ratio. One linear scan
finds all maximal scoring segments; a segment's significance follows from the
extreme-value law P(S >= x) = 1 - exp(-K n exp(-lambda x)), with lambda the
positive root of E[exp(lambda s)] = 1 over the other documents' tokens and K
fitted to their best segments. A document's statistic is the largest
-log p over its 1, 2, ... best segments' normalised sums; a logistic curve
fitted to the training documents maps it to a score in [0, 1].

Defined cases: null and empty texts have no segment and get the score of the
statistic 0; ties between segments keep text order; repeated rows score alike; texts
of any length are scored whole, in time linear in their tokens; a sample without both
classes gives the constant score of its base rate (0 if there is none); an empty table
gives an empty result; other columns pass through `score` and `stage` whatever their
names, except those beginning with __.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import fitted, held_out, labelled_sample, read
from sparkloom.llm.textbatch import LOWER, Texts, mix, pieces

THRESHOLD = 0.3
#: Bound of the sample that the model is fitted on, in rows; TRAIN_CHARS of `common` bounds its characters.
TRAIN_ROWS = 12_000
SEED = 6
PREFIXES = (8, 7, 6, 5)
#: A token is scored if it is in MIN_DOCS toxic documents and its log-odds are MIN_Z standard errors above 0.
MIN_DOCS, MIN_Z = 4, 4.0
#: Pseudo-counts of a token: this many, and this share of its count in the whole sample.
PRIOR_EACH, PRIOR_SHARE = 0.5, 0.02
#: Segments count up to this p-value.
MAX_P = 0.05
SPLIT = (4, 2)


@dataclass
class ToxicityModel:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = 0.0
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    intercept: float = 0.0
    constant: float | None = None

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def token_scores(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positive weights (0 for others) of all tokens; their starts, ends, and the first token of each text."""
        starts, ends, at, features = _features(texts)
        score = np.zeros(len(starts))
        if len(self.keys):
            for hashes, where in features:
                maybe = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
                found = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
                hit = self.keys[found] == hashes[maybe]
                to = maybe[hit] if where is None else where[maybe[hit]]
                score[to] = np.where(score[to] > 0, score[to], self.weights[found[hit]])
        return score, starts, ends, at

    def statistic(self, scores: np.ndarray, length: int) -> float:
        """-log p of a document of `length` tokens with these segment scores."""
        if not len(scores):
            return 0.0
        x = np.sort(self.lam * scores - np.log(self.k * length))[::-1]
        sums, r = np.cumsum(x), np.arange(1, len(x) + 1)
        logfact = np.cumsum(np.log(r))
        t = np.maximum(sums, 1e-9)
        logp = -t + (r - 1) * np.log(t) - logfact - (logfact - np.log(r))
        return float(max(0.0, -logp[sums > 0].min(initial=0.0)))

    def score(self, statistics: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(statistics), self.constant)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.log1p(statistics) + self.intercept, -50, 50)))

    def segments(self, texts: Texts) -> list[list[tuple[int, int, float]]]:
        """For each text the significant passages: byte span and score."""
        score, starts, ends, at = self.token_scores(texts)
        out = []
        for i in range(texts.n):
            a, b = at[i], at[i + 1]
            found = _maximal(score[a:b], self.drift)
            n = max(1, b - a)
            least = (np.log(self.k * n) - np.log(-np.log1p(-MAX_P))) / self.lam
            out.append([(int(starts[a + x] - texts.offsets[i]), int(ends[a + y - 1] - texts.offsets[i]), s) for x, y, s in found if s >= least])
        return out

    def statistics(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the statistic, the number of maximal segments, the best segment's score."""
        score, _, _, at = self.token_scores(texts)
        hits = np.flatnonzero(score > 0)
        first = np.searchsorted(hits, at)
        out, count, best = np.zeros(texts.n), np.zeros(texts.n, np.int64), np.zeros(texts.n)
        for i in np.flatnonzero(first[1:] > first[:-1]):
            found = np.array([s for _, _, s in _maximal(score[at[i] : at[i + 1]], self.drift, hits[first[i] : first[i + 1]] - at[i])])
            out[i], count[i], best[i] = self.statistic(found, int(at[i + 1] - at[i])), len(found), found.max()
        return out, count, best


def _features(texts: Texts):
    """Tokens, and for each kind of feature its hashes and the tokens they belong to (None: all)."""
    starts, ends, at = texts.tokens()
    sums = texts.prefix_hash(LOWER[texts.data])
    kinds = [(Texts.span_hash(sums, starts, ends), None)]
    for k in PREFIXES:
        where = np.flatnonzero(ends - starts > k)
        kinds.append((Texts.span_hash(sums, starts[where], starts[where] + k) ^ np.uint64(k), where))
    return starts, ends, at, kinds


def _maximal(score: np.ndarray, drift: float, hits: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of `score` where it is positive and `drift` (< 0) elsewhere, as (start, end, sum).

    Linear time: a stack of candidate segments with their left and right prefix
    sums, and for each the nearest earlier one whose left sum is lower.
    """
    hits = np.flatnonzero(score > 0) if hits is None else hits
    if not len(hits):
        return []
    stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, start, end, link
    total, last = 0.0, 0
    for h, s in zip(hits.tolist(), score[hits].tolist(), strict=True):
        total += drift * (h - last)
        last = h + 1
        left, start = total, h
        total += s
        right, end = total, last
        link = len(stack) - 1
        while True:
            while link >= 0 and stack[link][0] >= left:
                link = stack[link][4]
            if link < 0 or stack[link][1] >= right:
                stack.append((left, right, start, end, link))
                break
            left, start = stack[link][0], stack[link][2]
            del stack[link:]
            link = len(stack) - 1
    return [(x[2], x[3], x[1] - x[0]) for x in stack]


def first_of_copies(texts: list[str], labels: np.ndarray, hashes: int = 6) -> np.ndarray:
    """Indices of the texts without an earlier near copy of the same label: one that shares all but one of a few minima over five-word windows."""
    seen: set[tuple] = set()
    out = []
    for i in range(0, len(texts), 500):
        batch = Texts.of(texts[i : i + 500])
        starts, ends, at = batch.words()
        word = Texts.span_hash(batch.prefix_hash(), starts, ends)
        shingle = word.copy()
        for k in range(1, 5):
            shingle[:-k] = mix(shingle[:-k] * np.uint64(31) + word[k:])
        for d in range(batch.n):
            n = at[d + 1] - at[d]
            if n < 5:  # a text of fewer words is one window
                own = np.array([hash(tuple(word[at[d] : at[d + 1]].tolist())) & (2**64 - 1)], dtype=np.uint64)
            else:
                own = shingle[at[d] : at[d + 1] - 4]
            mins = [int(mix(own ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).min()) for k in range(hashes)]
            keys = [(k, int(labels[i + d]), *mins[:k], *mins[k + 1 :]) for k in range(hashes)]
            if not seen.intersection(keys):
                out.append(i + d)
                seen.update(keys)
    return np.array(out, dtype=np.int64)


def _document_features(texts: Texts) -> np.ndarray:
    """Hashes of the distinct features of each document, one document after the other."""
    _, _, at, kinds = _features(texts)
    doc = np.repeat(np.arange(texts.n), np.diff(at))
    hashes = np.concatenate([h for h, _ in kinds])
    owner = np.concatenate([doc if w is None else doc[w] for _, w in kinds])
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new]


def fit(texts: list[str], labels: np.ndarray) -> ToxicityModel:
    """Fit on a bounded sample held in memory; of near copies of one label in it only the first counts."""
    labels = np.asarray(labels, dtype=np.int64)
    first = first_of_copies(texts, labels)
    texts, labels = [texts[i] for i in first], labels[first]
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel(constant=float(labels.mean()) if len(labels) else 0.0)
    toxic_texts = [texts[i] for i in np.flatnonzero(labels == 1)]
    # candidates come from the toxic documents; the others are only counted for them
    found = np.concatenate([_document_features(Texts.of(toxic_texts[i : i + 250])) for i in range(0, len(toxic_texts), 250)])
    n_tox = len(found)
    keys, tox = np.unique(found, return_counts=True)
    keys, tox = keys[tox >= MIN_DOCS], tox[tox >= MIN_DOCS].astype(np.float64)
    del found
    if not len(keys):
        return ToxicityModel(constant=float(labels.mean()))
    other_texts = [texts[i] for i in np.flatnonzero(labels == 0)]
    non, n_non = np.zeros(len(keys)), 0
    for i in range(0, len(other_texts), 250):
        h = _document_features(Texts.of(other_texts[i : i + 250]))
        n_non += len(h)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        non += np.bincount(at[keys[at] == h], minlength=len(keys))
    prior = PRIOR_EACH + PRIOR_SHARE * (tox + non)
    all_prior = PRIOR_EACH * len(keys) + PRIOR_SHARE * (n_tox + n_non)
    a, b = tox + prior, non + prior
    odds = np.log(a / (n_tox + all_prior - a)) - np.log(b / (n_non + all_prior - b))
    z = odds / np.sqrt(1 / a + 1 / b)
    chosen = (z >= MIN_Z) & (tox >= MIN_DOCS)
    model = ToxicityModel(keys=keys[chosen], weights=odds[chosen])
    if not chosen.any():
        return ToxicityModel(constant=float(labels.mean()))
    # shares of scored tokens in either class give the drift, and the other class's token scores give lambda
    batches = [(texts[i : i + 250], labels[i : i + 250]) for i in range(0, len(texts), 250)]
    positive: dict[int, list[np.ndarray]] = {0: [], 1: []}
    tokens = {0: 0, 1: 0}
    for t, y in batches:
        scores, _, _, at = model.token_scores(Texts.of(t))
        owner = np.repeat(y, np.diff(at))
        for c in (0, 1):
            positive[c].append(scores[(owner == c) & (scores > 0)])
            tokens[c] += int(np.count_nonzero(owner == c))
    share = {c: (sum(map(len, positive[c])) + 0.5) / (tokens[c] + 1) for c in (0, 1)}
    drift = float(min(-1e-3, np.log1p(-share[1]) - np.log1p(-share[0])))
    hits = np.concatenate(positive[0])
    p_hit = share[0]
    values = hits if len(hits) else np.array([model.weights.min()])
    drift = min(drift, -1.5 * p_hit * float(values.mean()) / (1 - p_hit))  # the mean score must be negative
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        grows = p_hit * np.exp(np.minimum(mid * values, 700)).mean() + (1 - p_hit) * np.exp(mid * drift) > 1
        low, high = (low, mid) if grows else (mid, high)
    model.drift, model.lam = drift, (low + high) / 2
    best, length, stat = [], [], []
    for t, _ in batches:
        batch = Texts.of(t)
        _, _, top = model.statistics(batch)
        best.append(top)
        length.append(np.diff(batch.tokens()[2]))
    best, length = np.concatenate(best), np.concatenate(length)
    clean = labels == 0
    model.k = float(max(clean.sum(), 1) / max(1e-9, (length[clean] * np.exp(-model.lam * best[clean])).sum()))
    stat = np.concatenate([model.statistics(Texts.of(t))[0] for t, _ in batches])
    model.slope, model.intercept = _logistic(np.log1p(stat), labels)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for one input, with a weak ridge on the slope."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        w = p * (1 - p) + 1e-9
        g = np.array([(x * (y - p)).sum() - 0.1 * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    def run(sample: pa.Table) -> ToxicityModel:
        if not sample.num_rows:
            return fit([], np.zeros(0))
        order = np.argsort(sample["__id"].to_numpy(), kind="stable")
        return fit(sample["text"].take(order).to_pylist(), sample["y"].to_numpy()[order])

    return fitted(labelled_sample(docs, labels, "toxic", *SPLIT, rows, SEED), run)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs`, with __score, __statistic and __segments of the column text."""
    inputs = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, StructField("__score", DoubleType()), StructField("__statistic", DoubleType()), StructField("__segments", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            stat, count, _ = model.statistics(texts)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(model.score(stat)), pa.array(stat), pa.array(count)], names=[*keep, "__score", "__statistic", "__segments"])

    return inputs.mapInArrow(run, schema)


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row for each significant passage: doc_id, its text and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            ids, spans, scores = [], [], []
            raw = texts.data.tobytes()
            for i, (key, found) in enumerate(zip(batch.column(0).to_pylist(), model.segments(texts), strict=True)):
                for a, b, s in found:
                    ids.append(key)
                    spans.append(raw[texts.offsets[i] + a : texts.offsets[i] + b].decode("utf-8", "replace"))
                    scores.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "passage", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, passage string, score double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), *SPLIT).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"), F.col("__segments").alias("segments"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not toxic."""
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model, docs.columns).where(F.col("__score") < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
