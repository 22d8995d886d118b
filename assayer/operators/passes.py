"""Sums of arrays over all rows, for models that are fitted by repeated passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 1 << 17  # numbers


def total(rows: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], shape: tuple[int, ...], kind: str = "float64", step: int = 4096, fan: int = 8) -> np.ndarray:
    """What ``add(batch, sum)`` leaves in zeros of ``shape`` after all rows; it adds a batch of at most ``step`` rows in place.

    Tasks sum up their own rows. Their sums, cut into pieces, are dealt by piece over ``fan``
    tasks, which add them up, so that each number reaches the driver once. Of a piece whose rows (along the
    last dimension) mostly are zero only the others are sent.
    """
    width = shape[-1] if len(shape) > 1 else 1
    size, step_of = int(np.prod(shape)), max(1, PIECE // max(1, width))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros(shape, dtype=kind), False
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                add(batch.slice(i, step), held)
                seen = True
        if seen and size:
            lines = held.reshape(-1, width)
            for i in range(0, len(lines), step_of):
                yield from piece_of(i // step_of, lines[i : i + step_of])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, at, data in zip(*(c.to_pylist() for c in batch.columns)):
                if piece not in held:
                    held[piece] = np.zeros((min(step_of, size // width - piece * step_of), width), dtype=kind)
                put(held[piece], at, data)
        for piece, lines in held.items():
            yield from piece_of(piece, lines)

    def put(lines: np.ndarray, at: bytes | None, data: bytes) -> None:
        values = np.frombuffer(data, dtype=kind).reshape(-1, width)
        if at is None:
            lines += values
        else:
            lines[np.frombuffer(at, dtype="<i4")] += values

    def piece_of(piece: int, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero((lines != 0).any(axis=1)).astype("<i4")
        if len(at):
            few = 4 * len(at) < 3 * len(lines)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([at.tobytes() if few else None], pa.binary()), pa.array([(lines[at] if few else lines).tobytes()], pa.binary())], names=["piece", "at", "data"])

    schema = "piece int, at binary, data binary"
    parts = rows.mapInArrow(local, schema).repartition(fan, "piece").mapInArrow(merge, schema)
    out = np.zeros(shape, dtype=kind)
    lines = out.reshape(-1, width)
    for r in parts.collect():
        put(lines[r["piece"] * step_of : (r["piece"] + 1) * step_of], r["at"], r["data"])
    return out
