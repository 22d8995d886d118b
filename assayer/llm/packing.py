"""Best-fit packing of tokenised documents by hierarchical residual packing.

Every task packs its own pieces best-fit-decreasing and emits bins that are
nearly full. The rest become items themselves and meet the underfull bins of
other tasks in groups of bounded size, round after round, until one group holds
them all or a round no longer helps. No task sees more than its input split or
``group`` bins.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import piece_encoder
from .workspace import materialise, ship, trim

_MEMBER = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit-decreasing; returns the items' indices by bin. Sizes lie in 1..capacity.

    Bit r of ``free`` tells that some bin has exactly r places left, so the
    tightest bin for an item is the lowest set bit at or above its size.
    """
    bins: list[list[int]] = []
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := free >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = left[room].pop()
            if not left[room]:
                free ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room := room - size:
            left[room].append(b)
            free |= 1 << room
    return bins


def cut(ids: np.ndarray, end_id: int, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """``(piece, start, length, crc32)`` of ``ids`` and then ``end_id``, as little-endian uint32, in pieces of at most ``capacity``."""
    body, size = ids.astype("<u4", copy=False).tobytes() + end_id.to_bytes(4, "little"), 4 * capacity
    for piece, at in enumerate(range(0, len(body), size)):
        part = body[at : at + size]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def _batch(id_type: pa.DataType, bins: list[list[int]], sizes: np.ndarray, members: pa.StructArray, bounds: np.ndarray, done: np.ndarray, first: int) -> pa.RecordBatch:
    """Bins as rows; item i's members are rows ``bounds[i]`` to ``bounds[i + 1]`` of ``members``."""
    rows = [np.arange(bounds[i], bounds[i + 1]) for b in bins for i in b]
    taken = members.take(pa.array(np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)))
    lengths = taken.field("length").to_numpy()
    counts = np.array([sum(int(bounds[i + 1] - bounds[i]) for i in b) for b in bins], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    before = np.concatenate([[0], np.cumsum(lengths)])
    offsets = before[:-1] - np.repeat(before[ends[:-1]], counts)
    fields = [taken.field(n) for n in ("id", "piece", "start", "length", "ids_crc32")]
    made = pa.StructArray.from_arrays([*fields, pa.array(offsets, pa.int64())], fields=[pa.field("id", id_type), *(pa.field(n, t) for n, t in _MEMBER)])
    size = np.array([int(sizes[b].sum()) for b in bins], dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(first, first + len(bins)), pa.int64()), pa.array(done[: len(bins)]), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)],
        names=["sequence_id", "done", "size", "members"],
    )


def _pack(level: int, capacity: int, slack: int, id_type: pa.DataType, sizes: np.ndarray, members: pa.StructArray, bounds: np.ndarray, used: int, last: bool) -> Iterator[pa.RecordBatch]:
    bins = best_fit(sizes, capacity)
    fill = np.array([int(sizes[b].sum()) for b in bins], dtype=np.int64)
    done = np.full(len(bins), True) if last else capacity - fill <= slack
    first = (level << 56) + (TaskContext.get().partitionId() << 32) + used
    for i in range(0, len(bins), 2000):
        yield _batch(id_type, bins[i : i + 2000], sizes, members, bounds, done[i : i + 2000], first + i)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, slack: int = 8, group: int = 50_000, id_col: str = "doc_id", text_col: str = "text", flush: int = 200_000) -> DataFrame:
    """One row per piece: ``(id, piece, start, length, ids_crc32, sequence_id, offset)``.

    A document is its text's ids (null: none) and then ``end_id``; only those of
    more than ``capacity`` tokens are cut. A bin is emitted once at most ``slack``
    places are free; others are packed again with bins of other tasks. Repeated
    rows and null ids are packed like others; no rows give none. Very long texts are
    encoded whole. Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"sequence_id long, done boolean, size long, members array<struct<id:{kind},piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encoder, used = piece_encoder(tokenizer_path), 0
        ids, rows, id_type = [], [], None

        def emit() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*rows))
            at = pa.array(columns[0], pa.int64())
            all_ids = pa.concat_arrays(ids)
            members = pa.StructArray.from_arrays([all_ids.take(at), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], _MEMBER))], names=["id", *(n for n, _ in _MEMBER[:4])])
            sizes = members.field("length").to_numpy()
            yield from _pack(0, capacity, slack, id_type, sizes, members, np.arange(len(sizes) + 1), used, last=False)

        n = 0
        for batch in batches:
            id_type = batch.column(0).type
            ids.append(batch.column(0))
            for row, body in enumerate(encoder.encode(batch.column(1))):
                rows.extend((n + row, *part) for part in cut(body, end_id, capacity))
            n += batch.num_rows
            if len(rows) >= flush:
                yield from emit()
                used, n = used + len(rows), 0
                ids.clear(), rows.clear()
        if rows:
            yield from emit()

    def next_round(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if got:
                table = pa.Table.from_batches(got).combine_chunks()
                lists = table.column("members").chunk(0)
                members = lists.flatten()
                bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                yield from _pack(level, capacity, slack, members.field("id").type, table.column("size").to_numpy(), members, bounds, 0, last)

        return run

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary"))
    packed = materialise(source.mapInArrow(first_round, schema), "packed-0")
    finished, level = packed.where("done"), 1
    open_bins, n = packed.where("NOT done"), 0
    n = open_bins.count()
    while n:
        groups = math.ceil(n / group)
        packed = materialise(open_bins.repartition(groups).mapInArrow(next_round(level, groups == 1), schema), f"packed-{level}")
        finished, open_bins = finished.union(packed.where("done")), packed.where("NOT done")
        still = open_bins.count()
        if still > 0.99 * n:
            finished = finished.union(open_bins)
            break
        n, level = still, level + 1
    return finished.select("sequence_id", F.inline("members")).select("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
