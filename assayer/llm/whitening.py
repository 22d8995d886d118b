"""Whitening of embeddings by block subspace iteration, without a covariance matrix.

Entries become whole numbers, and the model is fitted to each distinct vector once.
A pass over these computes Xᵀ(XQ) for a block Q of columns on rows X that are centred
exactly, in whole numbers, before any product; the driver holds a few blocks of the
vectors' width. Each round sends the block through a Chebyshev polynomial of the
covariance (a pass for each degree) that damps what lies below the block's smallest
Ritz value, makes it orthonormal (QR) and projects (Rayleigh-Ritz). It ends when the
residuals |VQ - QE| of all components are as small as rounding allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.passes import total
from .workspace import materialise, ship

LIMIT = (1 << 62) - 1
EPS = float(np.finfo(np.float64).eps)


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; entries of 2^40 and more in size raise."""
    far = F.raise_error(F.lit("an entry of 2^40 or more is out of range")).cast("long")
    return F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) < float(1 << 40), F.floor(c.cast("double") * 64) + 1000000).otherwise(far))


def usable(vector: Column) -> Column:
    """Vectors that neither are null nor hold null or non-finite entries."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))


def matrix_of(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def from_mean(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S exactly: as 64-bit numbers where they suffice, as Python's otherwise."""
    floor = (sums // n).astype(np.int64)
    rest = (sums % n).astype(np.int64)
    step = x - floor
    if step.size and int(np.abs(step).max()) > LIMIT // n - 1:
        step, rest = step.astype(object), rest.astype(object)
    return step * n - rest


def sum_of_squares(d: np.ndarray) -> list[int]:
    """Exact, per row, for numbers of up to 62 bits, by limbs of 21 bits."""
    if d.dtype == object:
        return [sum(int(v) * int(v) for v in row) for row in d]
    size = np.abs(d)
    if not d.size or int(size.max()) ** 2 * d.shape[1] < LIMIT:
        return (d * d).sum(axis=1).tolist()
    low, mid, high = size & 0x1FFFFF, size >> 21 & 0x1FFFFF, size >> 42
    parts = [(low * low), 2 * low * mid, 2 * low * high + mid * mid, 2 * mid * high, high * high]
    return [sum(v << 21 * i for i, v in enumerate(row)) for row in zip(*(p.sum(axis=1).tolist() for p in parts))]


def summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: str) -> np.ndarray:
    """The sum of ``part(x)`` over all blocks of rows ``(x)``."""

    def add(batch: pa.RecordBatch, held: np.ndarray) -> None:
        held += part(matrix_of(batch.column(0), width))

    return total(rows, add, shape, kind)


@dataclass
class Model:
    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float


def subspace(apply: Callable[[np.ndarray], np.ndarray], width: int, k: int, block: int, trace: float, degree: int = 4, most_passes: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their vectors (columns) of the positive matrix behind ``apply``.

    What the block leaves of ``trace`` tells where the other eigenvalues lie on average; the
    polynomial damps from as far below that as the smallest Ritz value lies above, twice. Where
    a round on that guess gains little, the next ones damp from 0. Certified when each residual is at most 64 roundings of the largest eigenvalue, or,
    below 1e-11 of it, no longer falls. Where 40 passes haven't done it, the block doubles;
    as wide as the vectors it needs one pass. Raises when ``most_passes`` don't suffice.
    """
    rnd = np.random.default_rng(11)
    q, passes, before, grown, guess = np.linalg.qr(rnd.standard_normal((width, min(block, width))))[0], 0, np.inf, 0, True
    while True:
        y = apply(q)
        passes += 1
        h = q.T @ y
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        x, ax = q @ u, y @ u
        top = max(float(values[0]), 0.0)
        worst = float(np.linalg.norm(ax[:, :k] - x[:, :k] * values[:k], axis=0).max())
        if worst <= 64 * EPS * top or q.shape[1] == width or (worst <= 1e-11 * top and worst > before / 2):
            return values[:k], x[:, :k]
        if passes >= most_passes:
            raise ArithmeticError(f"residuals of {worst:g} after {passes} passes; the largest eigenvalue is {top:g}")
        guess, before = guess and worst < before / 4, worst
        if passes - grown >= 40:
            grown, more = passes, min(width, 2 * q.shape[1]) - q.shape[1]
            fresh = rnd.standard_normal((width, more))
            q, before = np.linalg.qr(np.hstack([x, fresh - x @ (x.T @ fresh)]))[0], np.inf
            continue
        high = max(float(values[-1]), top * EPS)
        mean = (trace - float(values.sum())) / (width - q.shape[1])
        low = max(0.0, min(3 * mean - 2 * high, 0.95 * high)) if guess else 0.0
        middle, half = (high + low) / 2, (high - low) / 2
        old, new = x, (ax - middle * x) / half
        for _ in range(degree - 1):
            scale = np.maximum(np.linalg.norm(new, axis=0), np.finfo(float).tiny)
            old, new = old / scale, new / scale
            old, new = new, 2 * (apply(new) - middle * new) / half - old
            passes += 1
        q = np.linalg.qr(new)[0]


def fit(x: DataFrame, width: int, components: int = 16, block: int = 48) -> Model:
    """The model of distinct vectors ``(x array<long>)`` of one ``width``, written so that passes can read them again.

    Components whose eigenvalue can't be told from zero (1e-13 of the largest, times the
    width) are left out, as nothing can be scaled by them.
    """
    seen = summed(x, width, lambda m: np.concatenate([(m >> 20).sum(axis=0), (m & 0xFFFFF).sum(axis=0), [len(m)]]), (2 * width + 1,), "int64").astype(object)
    n, sums = seen[-1], seen[:width] * (1 << 20) + seen[width:-1]
    centred = lambda m: from_mean(m, n, sums).astype(np.float64) / n
    trace = float(summed(x, width, lambda m: (centred(m) ** 2).sum(axis=0), (width,), "float64").sum() / n)
    if not trace:
        return Model(n, sums, np.empty((width, 0)), np.empty(0), 0.0, 0.0)

    def apply(q: np.ndarray) -> np.ndarray:
        def part(m: np.ndarray) -> np.ndarray:
            c = centred(m)
            return c.T @ (c @ q)

        return summed(x, width, part, q.shape, "float64") / n

    values, vectors = subspace(apply, width, min(components, width), block, trace)
    real = values > 1e-13 * width * values[0]
    values, vectors = values[real], vectors[:, real]
    scaled = vectors / np.sqrt(values)
    k = len(values)

    def spread(m: np.ndarray) -> np.ndarray:
        w = centred(m) @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    moments = summed(x, width, spread, (k + 1, k), "float64") / n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    return Model(n, sums, vectors, values, trace, error)


WHITE = "n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"


def apply_model(rows: DataFrame, width: int, model: Model) -> DataFrame:
    """``(id, x)`` -> ``(id, n, deviation, whitened, explained, identity_error)``."""
    scaled, explained = model.components / np.sqrt(model.values), (model.values / model.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                ids, x = batch.column(0).slice(i, 4096), matrix_of(batch.column(1).slice(i, 4096), width)
                off = from_mean(x, model.n, model.sums)
                white = (off.astype(np.float64) / model.n) @ scaled
                m, k = white.shape
                lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * k, pa.int32()), pa.array(v, pa.float64()))
                columns = [ids, pa.array([model.n] * m, pa.int64()), pa.array(sum_of_squares(off), pa.decimal128(38, 0)), lists(white.ravel()), lists(explained * m), pa.array([model.error] * m, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {WHITE}")


def whiten(table: DataFrame, components: int = 16, block: int = 48, id_col: str = "vec_id", vector_col: str = "embedding", most_widths: int = 64) -> DataFrame:
    """One row per vector: ``(id, n, deviation, whitened, explained, identity_error)``.

    ``whitened`` has the vector's distance from the mean along each of the first
    ``components`` principal components over the square root of their eigenvalues,
    largest first; ``explained`` the eigenvalues' shares. ``deviation`` is the exact sum of
    (n x - S)^2, ``identity_error`` how far the whitened fit list's covariance is from the identity.

    Vectors that are null or hold null or non-finite entries are left out. Repeated
    vectors count once in the fit, and each of their rows is returned; rows without an
    id are too. Vectors of several lengths (at most ``most_widths``) are spaces of their own;
    empty ones, and spaces in which all vectors are equal, have components of no length,
    so that their lists are empty. Equal eigenvalues give any orthonormal choice
    of their vectors, the same for all rows. An empty table gives no rows, and other columns take no part.
    """
    spark = table.sparkSession
    ship(spark)
    rows = table.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col)).alias("x"))
    distinct = materialise(rows.select("x").distinct(), "fit")
    widths = [r[0] for r in distinct.select(F.size("x").alias("width")).distinct().orderBy("width").limit(most_widths + 1).collect()]
    if len(widths) > most_widths:
        raise ValueError(f"vectors of more than {most_widths} lengths")
    parts = []
    for width in widths:
        here = F.size("x") == width
        model = fit(distinct.where(here), width, components, block) if width else Model(1, np.empty(0, np.int64), np.empty((0, 0)), np.empty(0), 1.0, 0.0)
        parts.append(apply_model(rows.where(here), width, model))
    if not parts:
        return spark.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, {WHITE}")
    return reduce(DataFrame.union, parts)
