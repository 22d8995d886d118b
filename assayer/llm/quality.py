"""Quality by a byte-level convolutional network in numpy.

A document's bytes are cut into half-chunks; filters of several bytes slide over
all of it. A chunk is two neighbouring halves, so chunks overlap and cover the
whole document; each filter's activation is max-pooled in a chunk, averaged over
the chunks, and a logistic unit makes one probability of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import sample_labelled
from .workspace import quoted, ship

HALF = 128  # bytes
WIDTH, STRIDE, FILTERS = 8, 2, 24


@dataclass
class QualityModel:
    """``table[k, b]``: what byte b at place k adds to each filter (row 0: padding, adds nothing)."""

    table: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    intercept: float


def _halves(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each padded to whole halves (two at least), and the halves per text."""
    counts = np.array([max(2, -(-len(t or b"") // HALF)) for t in texts], dtype=np.int64)
    parts = [(t or b"").ljust(int(n) * HALF, b"\0") for t, n in zip(texts, counts)]
    flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
    return flat, counts


def _windows(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``[place, position]`` bytes of every window; none looks past the end of its own text."""
    padded = np.concatenate([flat, np.zeros(WIDTH, dtype=np.uint8)])
    n = len(flat) // STRIDE
    windows = np.stack([padded[k : k + n * STRIDE : STRIDE] for k in range(WIDTH)])
    ends = np.cumsum(counts) * HALF
    for k in range(1, WIDTH):
        for back in range(STRIDE, k + 1, STRIDE):
            windows[k, (ends - back) // STRIDE] = 0
    return windows


def _half_maxima(model: QualityModel, windows: np.ndarray) -> np.ndarray:
    """Largest activation of each filter in each half-chunk."""
    per_half = HALF // STRIDE
    out = np.empty((windows.shape[1] // per_half, FILTERS), dtype=np.float32)
    step = 256 * per_half
    for i in range(0, windows.shape[1], step):
        part = windows[:, i : i + step]
        total = model.table[0][part[0]]
        for k in range(1, WIDTH):
            total += model.table[k][part[k]]
        out[i // per_half : (i + part.shape[1]) // per_half] = total.reshape(-1, per_half, FILTERS).max(axis=1)
    return np.maximum(out + model.bias, 0)


def features(model: QualityModel, texts: list[bytes | None]) -> np.ndarray:
    """Max-pooled activations of each text's overlapping chunks, averaged."""
    if not texts:
        return np.empty((0, FILTERS), dtype=np.float32)
    flat, counts = _halves(texts)
    halves = _half_maxima(model, _windows(flat, counts))
    chunks = np.maximum(halves[:-1], halves[1:])
    starts = np.concatenate([[0], np.cumsum(counts)])
    keep = np.ones(len(chunks), dtype=bool)
    keep[starts[1:-1] - 1] = False  # the pair that spans two texts
    first = starts[:-1] - np.arange(len(counts))
    return np.add.reduceat(chunks[keep], first, axis=0) / (counts - 1)[:, None].astype(np.float32)


def predict(model: QualityModel, texts: list[bytes | None], step: int = 4 << 20) -> np.ndarray:
    """Probability of each text, working on about ``step`` bytes at once."""
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < step):
            size += len(texts[j] or b"")
            j += 1
        line = features(model, texts[i:j]).astype(np.float64) @ model.weights + model.intercept
        out.append(1 / (1 + np.exp(-np.clip(line, -30, 30))))
        i = j
    return np.concatenate(out) if out else np.empty(0)


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 3, least_steps: int = 500, batch: int = 64, batch_bytes: int = 1 << 20, rate: float = 0.02, seed: int = 7) -> QualityModel:
    """Adam on weighted log loss over whole texts, ``batch`` at a time or fewer once they hold ``batch_bytes``; a
    small sample is gone through more often, up to ``least_steps`` steps."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
    table[:, 0] = 0
    params = {"table": table, "bias": np.zeros(FILTERS, np.float32), "weights": rng.normal(0, 0.3, FILTERS).astype(np.float32), "intercept": np.zeros(1, np.float32)}
    share = float(np.average(labels, weights=weights))
    params["intercept"][0] = np.log(share / (1 - share))
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    weights = weights / weights.mean()
    sizes = np.array([len(t) for t in texts])
    epochs = max(epochs, -(-least_steps // max(1, -(-len(texts) // batch))))
    plan = []
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        i = 0
        while i < len(order):
            j = i + max(1, int(np.searchsorted(np.cumsum(sizes[order[i : i + batch]]), batch_bytes, side="right")))
            plan.append(order[i:j])
            i = j
    for step, chosen in enumerate(plan, 1):
        grads = _gradients(QualityModel(params["table"], params["bias"], params["weights"], float(params["intercept"][0])), [texts[j] for j in chosen], labels[chosen], weights[chosen])
        now = rate * (1 - step / (len(plan) + 1))
        for k, g in grads.items():
            g = g + 1e-4 * params[k] * (k != "intercept")
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            params[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        params["table"][:, 0] = 0
    return QualityModel(params["table"], params["bias"], params["weights"].astype(np.float64), float(params["intercept"][0]))


def _gradients(model: QualityModel, texts: list[bytes], y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss; the maxima pass theirs to the windows that won."""
    flat, counts = _halves(texts)
    windows = _windows(flat, counts)
    total = model.table[0][windows[0]]
    for k in range(1, WIDTH):
        total += model.table[k][windows[k]]
    halves = total.reshape(-1, HALF // STRIDE, FILTERS)
    where = halves.argmax(axis=1)
    best = np.take_along_axis(halves, where[:, None, :], axis=1)[:, 0]
    active = best + model.bias
    pooled = np.maximum(active, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    text_of = np.repeat(np.arange(len(texts)), counts)
    left = np.flatnonzero(text_of[:-1] == text_of[1:])
    chunk_text = text_of[left]
    won = np.where(pooled[left] >= pooled[left + 1], left[:, None], left[:, None] + 1)
    chunk = np.take_along_axis(pooled, won, axis=0)
    x = np.add.reduceat(chunk, starts[:-1] - np.arange(len(texts)), axis=0) / (counts - 1)[:, None]
    p = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.intercept, -30, 30)))
    off = (w * (p - y) / len(texts)).astype(np.float32)
    g_chunk = (off / (counts - 1))[chunk_text][:, None] * np.asarray(model.weights, np.float32)[None, :]
    g_half = np.zeros_like(pooled)
    column = np.broadcast_to(np.arange(FILTERS), won.shape)
    np.add.at(g_half, (won, column), g_chunk)
    g_half *= active > 0
    rows, columns = np.nonzero(g_half)
    values = g_half[rows, columns]
    at = rows * (HALF // STRIDE) + where[rows, columns]
    g_table = np.zeros_like(model.table)
    for k in range(WIDTH):
        np.add.at(g_table[k], (windows[k][at], columns), values)
    return {"table": g_table, "bias": g_half.sum(axis=0), "weights": (off[:, None] * x).sum(axis=0).astype(np.float32), "intercept": np.array([off.sum()], np.float32)}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_class: int = 3000, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", **training) -> QualityModel:
    """Learn from at most ``per_class`` labelled documents of each class for which ``learn`` holds.

    The sample of at most ``2 * per_class`` whole documents and ``most_bytes`` is read to
    the driver and learned from there. Without both classes, as with empty tables, every
    score is 0 or 1. Null labels and ids are passed over, a null text counts as empty;
    other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    sample = sample_labelled(docs, labels, label, learn, per_class, most_bytes, id_col, text_col)
    rows = sample.select("text", "label", "weight").toArrow()
    y = rows.column("label").to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS), 30.0 if len(y) == 0 or y[0] == 1 else -30.0)
    texts = rows.column("text").to_pylist()
    order = np.argsort([zlib.crc32(t) for t in texts], kind="stable")  # the same whatever the partitions
    return train([texts[i] for i in order], y[order], rows.column("weight").to_numpy()[order], **training)


def _scores(rows: DataFrame, model: QualityModel) -> DataFrame:
    """``rows`` with ``text`` replaced by ``score double``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    others = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(predict(m, batch.column(0).to_pylist()), pa.float64())], names=[*batch.schema.names[1:], "score"])

    schema = T.StructType([*others, T.StructField("score", T.DoubleType())])
    return rows.select("text", *quoted([f.name for f in others])).mapInArrow(run, schema)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score double)`` per row. Null and empty texts are all padding and get the
    score of no activation; repeated rows and null ids keep a row each, very long texts
    are read whole, and an empty table gives no rows. Other columns are ignored."""
    ship(docs.sparkSession)
    return _scores(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), model).select("id", "score")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without rows that score under ``threshold``; all columns pass through, whatever their names."""
    ship(docs.sparkSession)
    names = docs.columns
    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.struct(*quoted(names)).alias("row"))
    return _scores(rows, model).where(F.col("score") >= threshold).select(*(F.col("row")[c].alias(c) for c in names))
