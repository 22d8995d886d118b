"""Exact deduplication by two-pass Bloom filtering.

Pass one hashes every text and builds a filter of the bits that at least two
rows set; only positions of bits shuffle for it, four bytes each. Pass two tests every row against it: a row of which some bit was set
once only is certainly unique and passes straight through; the others, all
repeated texts and a few chance hits, are the only rows that shuffle and are
compared by their SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import materialise, quoted, ship

BLOCK_BITS = 1 << 18
REPEAT = 10_000
SECOND = np.uint64(0x9E3779B97F4A7C15)


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions of 64-bit keys in a filter of ``bits`` (a power of two, 2^32 at most)."""
    keys = keys.view(np.uint64)
    return (keys & np.uint64(bits - 1)).astype(np.int64), ((keys * SECOND) >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def filter_size(rows: int, per_row: int = 16, max_bits: int = 1 << 30) -> tuple[int, int]:
    """Bits of a filter (a power of two) and how many there are.

    ``max_bits`` bounds what is broadcast at a time; more rows get several
    filters, one for each part of the keys.
    """
    bits, parts = BLOCK_BITS, 1
    while bits < min(rows * per_row, max_bits):
        bits *= 2
    while parts * bits < rows * per_row:
        parts *= 2
    return bits, parts


def repeated_bits(keys: DataFrame, bits: int, flush: int = 4_000_000) -> np.ndarray:
    """The filter over ``keys (key long)``: bits that two rows or more set, packed.

    Tasks keep the bits that their rows set once and those set more often, and send
    them as sorted positions by block; blocks are merged, and at most ``bits / 8``
    bytes reach the driver.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def emit() -> pa.RecordBatch:
            at, times = np.unique(np.concatenate(held), return_counts=True)
            blocks, inner = at // BLOCK_BITS, (at % BLOCK_BITS).astype("<u4")
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            pick = lambda chosen: [p[c].tobytes() for p, c in zip(np.split(inner, cuts), np.split(chosen, cuts))]
            return pa.RecordBatch.from_arrays([pa.array(blocks[np.concatenate([[0], cuts])]), pa.array(pick(times == 1), pa.binary()), pa.array(pick(times > 1), pa.binary())], names=["block", "once", "more"])

        for batch in batches:
            if batch.num_rows:
                held.extend(_places(batch.column(0).to_numpy(zero_copy_only=False), bits))
                n += 2 * batch.num_rows
            if n >= flush:
                yield emit()
                held, n = [], 0
        if held:
            yield emit()

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        times = np.zeros(BLOCK_BITS, dtype=np.uint8)
        for once, more in zip(rows.column("once").to_pylist(), rows.column("more").to_pylist()):
            at = np.frombuffer(once, "<u4")
            times[at] = np.minimum(times[at] + 1, 2)
            times[np.frombuffer(more, "<u4")] = 2
        return pa.table({"block": [key[0].as_py()], "body": [np.packbits(times > 1, bitorder="little").tobytes()]})

    blocks = keys.mapInArrow(mark, "block long, once binary, more binary").groupBy("block").applyInArrow(merge, "block long, body binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for block, body in blocks.collect():
        out[block * BLOCK_BITS // 8 :][: BLOCK_BITS // 8] = np.frombuffer(bytes(body), dtype=np.uint8)
    return out


def mark_suspects(rows: DataFrame, key: str, bits: int, shared) -> DataFrame:
    """``rows`` with ``__suspect``: all bits of ``key`` are set in the broadcast filter."""
    at = rows.schema.fieldNames().index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            hit = np.ones(batch.num_rows, dtype=bool)
            for place in _places(batch.column(at).to_numpy(zero_copy_only=False), bits):
                hit &= (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, "__suspect"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__suspect", T.BooleanType())]))


class Filters:
    """Marks the rows of a table whose keys may repeat, ``keys (key)`` being those of all its rows.

    One filter serves while it holds all keys. Of more rows each part of the keys gets its own, one
    after another: its rows are marked and written before the next one is made, so that the
    driver and the tasks never hold more than one.
    """

    def __init__(self, keys: DataFrame, per_row: int, max_bits: int):
        self.keys = keys
        self.bits, self.parts = filter_size(keys.count(), per_row, max_bits)
        self.single = repeated_bits(keys, self.bits) if self.parts == 1 else None

    def mark(self, rows: DataFrame, key: str) -> DataFrame:
        if self.parts == 1:
            return mark_suspects(rows, key, self.bits, rows.sparkSession.sparkContext.broadcast(self.single))
        out = []
        for i in range(self.parts):
            part = lambda some, name: some.where(F.pmod(F.xxhash64(name), F.lit(self.parts)) == i)  # noqa: B023, E731
            shared = rows.sparkSession.sparkContext.broadcast(repeated_bits(part(self.keys, "key"), self.bits))
            out.append(materialise(mark_suspects(part(rows, key), key, self.bits, shared), "marked"))
            shared.destroy()
        return reduce(DataFrame.union, out)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """One row per document: ``(id, keep_id, group_size, kept, text_sha256)``.

    Of equal texts (null counts as empty) the largest id stays. Of rows that
    repeat id and text alike exactly one is kept. A null id loses to any other;
    a group of null ids only keeps one row under ``keep_id`` null. Very long texts
    are hashed whole. Other columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    ship(docs.sparkSession)
    hashes = materialise(docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("sha")).withColumn("key", F.xxhash64("sha")), "hashes")
    marked = Filters(hashes.select("key"), per_row, max_bits).mark(hashes, "key")
    unique = marked.where("NOT __suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    repeated = marked.where("__suspect").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"))
    # Both sides of the join are read from files, so that a hash with very many ids can be split.
    repeated = materialise(repeated, "repeated")
    groups = materialise(repeated.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    # A row that stands for many is written out a block at a time.
    blocks = repeated.join(groups, "sha").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEAT).cast("long"))).alias("from"))
    expanded = blocks.select("*", F.explode(F.sequence("from", F.least(F.col("from") + REPEAT, "n") - 1)).alias("i"))
    return unique.union(expanded.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 0)).alias("kept"), F.col("sha").alias("text_sha256")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """``docs`` with one row of each distinct text: that with the largest id.

    Rows that are certainly unique never shuffle. Of the others, SHA-256 and ids
    choose the row that stays; of rows that repeat id and text alike one stays.
    A null id loses to any other; a group without any id stays whole. Null counts
    as empty; all columns pass through, whatever their names, and an empty table
    stays empty.
    """
    ship(docs.sparkSession)
    names = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*quoted(names)).alias("__row"), F.col(id_col).alias("__id"), F.xxhash64(text).alias("__key"))
    filters = Filters(keyed.select(F.col("__key").alias("key")), per_row, max_bits)
    lean = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__key"))
    # With several filters the whole rows are marked, and written, once; else they pass by the one filter twice.
    marked = filters.mark(keyed, "__key")
    told = filters.mark(lean, "__key") if filters.parts == 1 else marked.select("__id", F.coalesce(F.col("__row")[text_col], F.lit("")).alias("__text"), "__suspect")
    suspects = told.where("__suspect").select("__id", text_hash(F.col("__text")).alias("__sha"))
    by_id = materialise(suspects.groupBy("__sha", "__id").agg(F.count(F.lit(1)).alias("n")), "suspects")
    best = F.max(F.when(F.col("__id").isNotNull(), F.struct("__id", "n")))
    repeated = by_id.groupBy("__sha").agg(best.alias("best"), F.sum("n").alias("size")).where("size > 1 AND best IS NOT NULL")
    repeated = materialise(repeated.select("__sha", F.col("best.__id").alias("__keep"), (F.col("best.n") > 1).alias("__twice")), "repeated")
    held = marked.where("__suspect").select("__row", "__id", text_hash(F.col("__row")[text_col]).alias("__sha")).join(repeated, "__sha", "left").where("__keep IS NULL OR __id = __keep")
    kept = marked.where("NOT __suspect").select("__row")
    if repeated.where("__twice").isEmpty():
        kept = kept.union(held.select("__row"))
    else:
        held = materialise(held, "held")
        kept = kept.union(held.where("__twice IS NOT TRUE").select("__row")).union(held.where("__twice").dropDuplicates(["__sha"]).select("__row"))
    return kept.select(*(F.col("__row")[c].alias(c) for c in names))
