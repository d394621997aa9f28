"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The
probability of a word is the sum, over all ways to cut it into pieces, of the
product of their probabilities; a forward algorithm sums them for all words of
equal length and all languages at once. A text's languages are compared by the
sum of their words' log-probabilities and the languages' frequencies. Distinct
words are summed once per worker.

Probabilities come from expected piece counts: forward-backward over the distinct
training words under a distribution common to all languages (two rounds of
expectation maximisation), shared out by each word's counts in the languages,
with a Dirichlet prior around the common distribution.

Words are runs of letters, folded to lower case; characters that no piece covers
cost every language the same. Long words (scripts without spaces) are summed whole,
a part at a time with the sums at the cut carried over; training counts the pieces of
their parts of PART letters.

Defined cases: a null text, and one without a letter, is `und` with score 0; so is
every text if there is nothing to learn from; ties go to the language that sorts
first; repeated rows are scored alike; texts of any length are scored whole, in time
linear in their letters; languages beyond the MAX_LANGUAGES most frequent aren't learnt;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded, fitted, held_out, read
from sparkloom.llm.lattice import PieceTable, code_points, edges_by_end
from sparkloom.llm.textbatch import Interner, Texts, pieces

#: Bounds of the training sample: documents of each language, and languages, the most frequent ones; TRAIN_CHARS of `common` bounds a language's characters.
TRAIN_ROWS, MAX_LANGUAGES = 1_500, 400
SEED, SPLIT = 7, (4, 2)
#: Distinct words that a worker keeps between tasks.
MOST_WORDS = 800_000
#: Letters after which sums are scaled anew, and at which long words are cut for training.
ROUNDS, PRIOR, UNCOVERED, SCALE, PART = 2, 2_000.0, 1e-8, 32.0, 32

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of a SentencePiece model file, without control, byte and unknown pieces and runs of spaces."""
    from pathlib import Path

    from sentencepiece import sentencepiece_model_pb2

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Path(path).read_bytes())
    return [p.piece for p in proto.pieces if p.type == 1 and p.piece.strip("▁") or p.piece == "▁"]


def word_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return texts.runs(_LETTER[texts.data])


def normal_word(raw: str) -> str:
    """Folded letters behind a word mark, or nothing."""
    letters = "".join(c for c in raw.lower() if c.isalpha())
    return "▁" + letters if letters else ""


def forward(table: PieceTable, points: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, list]:
    """Scaled forward sums alpha[rows, length + 1, languages], and the lattice's edges."""
    rows, length = points.shape
    edges = edges_by_end(table, points)
    alpha = np.zeros((rows, length + 1, p.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, length + 1):
        bare = np.ones(rows, dtype=bool)
        for size, row, number in edges[end]:
            alpha[row, end] += alpha[row, end - size] * p[number] * SCALE**size
            if size == 1:
                bare[row] = False
        alpha[bare, end] += alpha[bare, end - 1] * (UNCOVERED * SCALE)
    return alpha, edges


def log_probabilities(table: PieceTable, words: list[str], p: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    long = [i for i, w in enumerate(words) if len(w) > PART]
    short = [i for i, w in enumerate(words) if len(w) <= PART]
    for where, points in code_points([words[i] for i in short]):
        step = max(1, 400_000 // max(1, points.shape[1] * p.shape[1]))
        for i in range(0, len(where), step):
            alpha, _ = forward(table, points[i : i + step], p)
            out[np.array(short, dtype=np.int64)[where[i : i + step]]] = np.log(alpha[:, -1]) - points.shape[1] * np.log(SCALE)
    long.sort(key=lambda i: len(words[i]))
    at = 0
    while at < len(long):
        group = [long[at]]
        while at + len(group) < len(long) and len(words[long[at + len(group)]]) <= 1.2 * len(words[group[0]]) and len(group) * PART * p.shape[1] < 400_000:
            group.append(long[at + len(group)])
        out[group] = _log_long(table, [words[i] for i in group], p)
        at += len(group)
    return out


def _log_long(table: PieceTable, words: list[str], p: np.ndarray) -> np.ndarray:
    """The same for words above PART letters: a part at a time, with the sums at the last letters, as many as the longest piece has, carried over the cut and scaled by their largest."""
    carry = table.longest
    sizes = np.array([len(w) for w in words])
    points = np.zeros((len(words), int(sizes.max())), dtype=np.uint32)  # no piece holds the character 0
    for i, w in enumerate(words):
        points[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros((len(words), p.shape[1]))
    logs = np.zeros((len(words), p.shape[1]))
    tail = np.zeros((len(words), carry, p.shape[1]))  # sums at the letters before the part, the last one at the end
    tail[:, -1] = 1
    for begin in range(0, points.shape[1], PART):
        before = min(carry - 1, begin)
        part = points[:, begin - before : begin + PART]
        edges = edges_by_end(table, part)
        width = part.shape[1] - before
        alpha = np.concatenate([tail, np.zeros((len(words), width, p.shape[1]))], axis=1)  # alpha[:, carry - 1 + j] after j letters of the part
        for j in range(1, width + 1):
            bare = np.ones(len(words), dtype=bool)
            for size, row, number in edges[before + j]:
                alpha[row, carry - 1 + j] += alpha[row, carry - 1 + j - size] * p[number] * SCALE**size
                if size == 1:
                    bare[row] = False
            alpha[bare, carry - 1 + j] += alpha[bare, carry - 2 + j] * (UNCOVERED * SCALE)
        ends = np.flatnonzero((sizes > begin) & (sizes <= begin + width))
        with np.errstate(divide="ignore"):
            out[ends] = np.log(alpha[ends, carry - 1 + sizes[ends] - begin]) + logs[ends] - (sizes[ends] * np.log(SCALE))[:, None]
        tail = alpha[:, -carry:]
        top = np.maximum(tail.max(axis=1), 1e-300)
        tail = tail / top[:, None]
        logs += np.log(top)
    return out


def expected_counts(table: PieceTable, words: list[str], p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(pieces, languages): expected piece counts of words with `counts` (words, languages) under one distribution p."""
    out = np.zeros((len(p), counts.shape[1]))
    for where, points in code_points(words):
        step = max(1, 200_000 // max(1, points.shape[1]))
        for i in range(0, len(where), step):
            own = where[i : i + step]
            alpha, edges = forward(table, points[i : i + step], p[:, None])
            alpha = alpha[:, :, 0]
            rows, length = len(own), points.shape[1]
            beta = np.zeros((rows, length + 1))
            beta[:, length] = 1
            for end in range(length, 0, -1):
                bare = np.ones(rows, dtype=bool)
                for size, row, number in edges[end]:
                    beta[row, end - size] += beta[row, end] * p[number] * SCALE**size
                    if size == 1:
                        bare[row] = False
                beta[bare, end - 1] += beta[bare, end] * (UNCOVERED * SCALE)
            z = alpha[:, length]
            for end in range(1, length + 1):
                for size, row, number in edges[end]:
                    post = alpha[row, end - size] * p[number] * SCALE**size * beta[row, end] / z[row]
                    share = post[:, None] * counts[own[row]]
                    for k in range(counts.shape[1]):
                        out[:, k] += np.bincount(number, share[:, k], len(p))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    p: np.ndarray
    prior: np.ndarray
    vocabulary: list[str]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def fit(texts: list[str], langs: list[str], pieces_: list[str]) -> LanguageModel:
    """Fit on a bounded sample held in memory."""
    languages = sorted(set(langs))
    index = {k: i for i, k in enumerate(languages)}
    table = PieceTable(pieces_)
    counts: dict[str, np.ndarray] = {}
    for i in range(0, len(texts), 200):
        batch = Texts.of(texts[i : i + 200])
        starts, ends, at = word_spans(batch)
        h = Texts.span_hash(batch.prefix_hash(), starts, ends)
        lang = np.repeat([index[x] for x in langs[i : i + 200]], np.diff(at)).astype(np.int64)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(inverse * len(languages) + lang, minlength=len(keys) * len(languages)).reshape(-1, len(languages))
        for raw, row in zip(batch.strings(starts[first], ends[first]), n, strict=True):
            whole = normal_word(raw)
            for k in range(0, len(whole), PART):
                w = whole[k : k + PART]
                counts[w] = counts[w] + row if w in counts else row
    words = list(counts)
    by_lang = np.array([counts[w] for w in words], dtype=np.float64).reshape(-1, len(languages))
    p = np.full(len(pieces_), 1 / max(1, len(pieces_)))
    for _ in range(ROUNDS):
        c = expected_counts(table, words, p, by_lang)
        common = c.sum(axis=1) + 0.01
        p = common / common.sum()
    each = (c + PRIOR * p[:, None]) / (c.sum(axis=0) + PRIOR)
    docs = np.array([langs.count(k) for k in languages], dtype=np.float64)
    return LanguageModel(languages, each, np.log(docs / max(1.0, docs.sum())), pieces_)


class Scorer:
    """A model with the words that this worker has summed."""

    def __init__(self, model: LanguageModel):
        self.model, self.table = model, PieceTable(model.vocabulary)
        self.cache, self.epoch = Interner(MOST_WORDS), -1

    def _clear(self) -> None:
        self.logs = np.zeros((1 << 14, len(self.model.languages)))
        self.letters = np.zeros(1 << 14, dtype=bool)

    def predict(self, texts: Texts) -> tuple[list[str], np.ndarray]:
        model = self.model
        none = ["und"] * texts.n, np.zeros(texts.n)
        if not model.languages or not len(texts.data):
            return none
        starts, ends, at = word_spans(texts)
        codes, fresh = self.cache.codes(Texts.span_hash(texts.prefix_hash(), starts, ends))
        if self.cache.epoch != self.epoch:
            self.epoch = self.cache.epoch
            self._clear()
        while self.cache.n > len(self.letters):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        if len(fresh):
            words = [normal_word(w) for w in texts.strings(starts[fresh], ends[fresh])]
            new = slice(self.cache.n - len(fresh), self.cache.n)
            self.logs[new] = log_probabilities(self.table, words, model.p)
            self.letters[new] = [bool(w) for w in words]
        owner = np.repeat(np.arange(texts.n), np.diff(at))
        total = np.stack([np.bincount(owner, self.logs[codes, k], texts.n) for k in range(len(model.languages))], axis=1) + model.prior
        some = np.bincount(owner, self.letters[codes], texts.n) > 0
        best = total.argmax(axis=1)
        post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [model.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, post, 0.0)


_scorers: dict[str, Scorer] = {}


def train(docs: DataFrame, rows: int = TRAIN_ROWS, path: str | None = None) -> LanguageModel:
    """Per language the `rows` training documents of least seeded hash.

    Counts by language give a bound on the hash that leaves some more than `rows`
    documents of each; only those ids are sent to their language's order. The
    sample is fitted in one task.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), *SPLIT)).select(F.col("doc_id").alias("__id"), F.col("lang").cast("string").alias("__lang"))
    counts = known.groupBy("__lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "__lang").limit(MAX_LANGUAGES)
    turn = F.xxhash64(F.lit(SEED), "__id")
    share = (turn.cast("double") + 2.0**63) / 2.0**64
    near = known.join(F.broadcast(counts), "__lang").where(share * F.col("n") <= rows + 8 * rows**0.5 + 64)
    own = Window.partitionBy("__lang").orderBy(turn, "__id")
    chosen = near.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= rows).select("__id", "__lang").distinct()
    # at most `rows` ids of each of MAX_LANGUAGES languages are broadcast
    found = docs.select(F.col("doc_id").alias("__id"), F.col("lang").cast("string").alias("__lang"), F.coalesce("text", F.lit("")).alias("text"))
    sample = bounded(found.join(F.broadcast(chosen), ["__id", "__lang"]), ["__lang"], SEED)

    def run(table: pa.Table) -> LanguageModel:
        if not table.num_rows:
            return LanguageModel([], np.zeros((0, 0)), np.zeros(0), [])
        table = table.sort_by([("__id", "ascending"), ("text", "ascending")])
        return fit(table["text"].to_pylist(), table["__lang"].to_pylist(), vocabulary(path))

    return fitted(sample, run)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.key not in _scorers:
            _scorers.clear()
            _scorers[model.key] = Scorer(model)
        for batch, texts in pieces(batches):
            pred, score = _scorers[model.key].predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs, train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id"), *SPLIT).alias("held_out"), "lang_pred", "score")
