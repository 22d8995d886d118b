"""Toxicity by maximum-scoring segments of token log-odds.

Words, or failing them their prefixes, get the log-odds of toxic against other
training documents under an informative Dirichlet prior. A linear scan finds all maximal segments of a
document; those whose extreme-value E-value is small are its toxic passages.
Their strength becomes a probability through a logistic curve fitted to the
training documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import sample_labelled
from .workspace import quoted, ship

#: ASCII letters in lower case, ASCII punctuation and controls as spaces, other bytes as they are.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(CLEAN).split()


PREFIXES = (7, 6, 5, 4, 3)  # characters; inflected forms share the evidence of their stem


def features_of(word: bytes) -> list[bytes]:
    """The word itself, then its marked prefixes from the longest."""
    text = word.decode("utf-8", "replace")
    return [word, *(b"^" + text[:k].encode() for k in PREFIXES if len(text) > k)]


class _WordScores(dict):
    """Scores of words by their most specific feature, worked out when first asked for."""

    def __init__(self, odds: dict[bytes, float], other: float, limit: int = 300_000):
        super().__init__()
        self.odds, self.other, self.limit = odds, other, limit

    def __missing__(self, word: bytes) -> float:
        found = next((self.odds[f] for f in features_of(word) if f in self.odds), self.other)
        if len(self) >= self.limit:
            self.clear()
        self[word] = found
        return found


@dataclass(frozen=True)
class ToxicityModel:
    """``odds`` by feature, ``other`` for words without evidence; ``lam`` and ``k`` of the
    extreme-value law; a logistic curve ``intercept + slope * strength``."""

    odds: dict[bytes, float]
    other: float
    lam: float = 1.0
    k: float = 0.1
    intercept: float = 0.0
    slope: float = 0.0

    def word_scores(self) -> _WordScores:
        return _WordScores(self.odds, self.other)

    def normalised(self, score: float, n: int) -> float:
        """-ln of the number of segments this good expected in ``n`` words of clean text."""
        return self.lam * score - math.log(self.k * max(1, n))

    def strength(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """-ln of the chance of the best r segments' summed score, for the r that makes it largest; within -3 and 30."""
        best, total = WEAKEST, 0.0
        for r, s in enumerate(sorted((self.normalised(s, n) for _, _, s in segments), reverse=True), 1):
            if r > 1 and s <= 0:
                break
            total += s
            best = max(best, total if r == 1 else total - (r - 1) * math.log(max(1.0, total)) + math.lgamma(r + 1) + math.lgamma(r))
        return min(best, STRONGEST)


WEAKEST, STRONGEST = -3.0, 30.0
SIGNIFICANT = 3.0  # an E-value of about 0.05


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, end, score)`` in linear time.

    Only runs of positive scores are stepped through; the losses between them
    come from running totals. Each segment keeps the totals before and after it;
    a new one joins the nearest earlier one that starts lower, if it ends higher.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    open_: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, nearest lower start
    for i in positive.tolist():
        first, end, low, high = i, i + 1, totals[i], totals[i + 1]
        j = len(open_) - 1
        while True:
            while j >= 0 and open_[j][2] >= low:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= high:
                break
            first, low = open_[j][0], open_[j][2]
            del open_[j:]
            j -= 1
        open_.append((first, end, low, high, j))
    return [(a, b, float(high - low)) for a, b, low, high, _ in open_]


def _counted(sample: DataFrame, count, flush: int = 200_000) -> DataFrame:
    """``(word binary, toxic, clean)`` summed over the sample; ``count(words)`` makes a document's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def emit() -> pa.RecordBatch:
            keys = list(sums[0].keys() | sums[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([sums[i][k] for k in keys], pa.int64()) for i in (1, 0))], names=["word", "toxic", "clean"])
            sums[0].clear(), sums[1].clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                sums[label].update(count(words_of(text.as_py())))
                if len(sums[0]) + len(sums[1]) > flush:
                    yield emit()
        if sums[0] or sums[1]:
            yield emit()

    found = sample.select("text", "label").mapInArrow(run, "word binary, toxic long, clean long")
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _document_features(words: list[bytes]) -> Counter:
    return Counter({f: 1 for w in set(words) for f in features_of(w)})


def _log_odds(prior: float, toxic: Column, clean: Column, n1: float, n0: float) -> tuple[Column, Column]:
    """Log-odds under a Dirichlet prior of ``prior`` pseudo-counts shaped like both classes together, and its z-score."""
    alpha = (toxic + clean) / F.lit(float(n0 + n1)) * prior
    t, c = toxic + alpha, clean + alpha
    odds = F.log(t / (n1 + prior + 1 - t)) - F.log(c / (n0 + prior + 1 - c))
    return odds, odds / F.sqrt(1 / t + 1 / c)


def _odds_model(sample: DataFrame, prior: float, token_prior: float, least_z: float, least_docs: int, least_odds: float) -> ToxicityModel:
    """The odds of a sample of labelled documents, without a curve; without both classes a constant score."""
    sums = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sums) < 2:
        return ToxicityModel({}, -0.02, intercept=30.0 if 1 in sums else -30.0)
    counts = _counted(sample, _document_features).where(F.col("toxic") + F.col("clean") >= least_docs)
    odds, z = _log_odds(prior, F.col("toxic"), F.col("clean"), sums[1], sums[0])
    chosen = counts.select("word", odds.alias("odds"), z.alias("z")).where((F.col("z") >= least_z) & (F.col("odds") >= least_odds))
    features = {bytes(r["word"]) for r in chosen.select("word").collect()}

    def by_feature(words: list[bytes]) -> Counter:
        found: Counter = Counter()
        for w, n in Counter(words).items():
            found[next((f for f in features_of(w) if f in features), b"")] += n
        return found

    tokens = {bytes(r["word"]): (r["toxic"], r["clean"]) for r in _counted(sample, by_feature).collect()}
    n1, n0 = (sum(v[i] for v in tokens.values()) for i in (0, 1))
    shares = {}
    for f in sorted(features & tokens.keys()):
        alpha = sum(tokens[f]) / (n0 + n1) * token_prior
        shares[f] = (tokens[f][0] + alpha) / (n1 + token_prior), (tokens[f][1] + alpha) / (n0 + token_prior)
    shares = {f: v for f, v in shares.items() if v[0] > v[1]}
    table = {f: math.log(p1 / p0) for f, (p1, p0) in shares.items()}
    other = math.log((1 - sum(p for p, _ in shares.values())) / (1 - sum(p for _, p in shares.values()))) if shares else -0.02
    return ToxicityModel(table, other, _lambda([(table[f], p0) for f, (_, p0) in shares.items()], -other) if table else 1.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = 6000, most_bytes: int = 64 << 20, prior: float = 500.0, token_prior: float = 5000.0, least_z: float = 3.5, least_docs: int = 6, least_odds: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from at most ``per_class`` labelled documents of each class, whole and of ``most_bytes`` together, for
    which ``learn`` holds.

    Features (words and, for words without evidence of their own, their prefixes) are
    chosen by the z-score of their document counts, so that repetition in a document
    doesn't weigh; the scores are log-odds of token counts, each word counting for its
    most specific feature, and all other words share the small negative rest. The
    curve is fitted to strengths of documents under odds from the other half of the
    sample. Without both classes, as with empty tables, every document gets 0, or 1 if
    all that is known is toxic. Null labels and ids are passed over, a null text
    counts as empty; other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    sample = sample_labelled(docs, labels, label, learn, per_class, most_bytes, id_col, text_col)
    options = (prior, token_prior, least_z, least_docs, least_odds)
    plain = _odds_model(sample, *options)
    if not plain.odds:
        return plain
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2))
    seen = []
    for side in (0, 1):
        model = _odds_model(sample.where(half != side), *options)
        seen.append(_strengths(sample.where(half == side), model).select("strength", "label", "weight").toPandas())
    x, y, w = (np.concatenate([s[c].to_numpy(dtype=np.float64) for s in seen]) for c in ("strength", "label", "weight"))
    intercept, slope = _logistic(x, y, w)
    return replace(plain, intercept=intercept, slope=slope)


def _lambda(positive: list[tuple[float, float]], drift: float) -> float:
    """The positive root of sum p * exp(l * s) = 1 over clean text, other words costing ``drift``."""
    rest = 1 - sum(p for _, p in positive)
    gain = lambda x: sum(p * math.exp(min(500.0, x * s)) for s, p in positive) + rest * math.exp(-x * drift) - 1
    low, high = 1e-6, 1e-3
    while gain(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if gain(mid) < 0 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Weighted logistic curve in one variable, by Newton's method."""
    a = np.stack([np.ones_like(x), x / 10], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (w * (y - p)) - ridge * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(0.0, beta[1] / 10))


def _strengths(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """``rows`` with ``text`` replaced by ``strength double, passages array`` of word ranges and scores."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    others = [f for f in rows.schema.fields if f.name != "text"]
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = m.word_scores().__getitem__
        for batch in batches:
            strengths, found = [], []
            for text in batch.column(0):
                words = words_of(text.as_py())
                segments = maximal_segments(np.fromiter(map(scores, words), dtype=np.float64, count=len(words)))
                strengths.append(m.strength(segments, len(words)))
                found.append([{"first": a, "end": b, "score": s} for a, b, s in segments if m.normalised(s, len(words)) >= SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(strengths, pa.float64()), pa.array(found, span)], names=[*batch.schema.names[1:], "strength", "passages"])

    spans = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*others, T.StructField("strength", T.DoubleType()), T.StructField("passages", spans)])
    return rows.select("text", *quoted([f.name for f in others])).mapInArrow(run, schema)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score double, passages array)`` per row: every significant passage as word
    positions with its score, and the document's probability. Null and empty texts have
    no passage and get the curve's floor; repeated rows and null ids keep a row each, very
    long texts are read whole, and an empty table gives no rows. Other columns are ignored."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return _strengths(rows, model).select("id", logistic_column(model).alias("score"), "passages")


def logistic_column(model: ToxicityModel) -> Column:
    line = F.lit(model.intercept) + F.lit(model.slope) * F.col("strength")
    return 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), line))))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; all columns pass through, whatever their names."""
    ship(docs.sparkSession)
    names = docs.columns
    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.struct(*quoted(names)).alias("row"))
    return _strengths(rows, model).where(logistic_column(model) < threshold).select(*(F.col("row")[c].alias(c) for c in names))
