"""SimHash near-duplicate groups by a grid join on per-segment bit counts.

A fingerprint's 64 bits are cut into segments of two bits, once from the even
positions and once from the odd ones; each cut's vector of bit counts (packed
into one long) embeds it so that the Manhattan distance of two vectors never
exceeds the fingerprints' Hamming distance. The segments are dealt over
``blocks`` blocks, leaving out those that straddle two. Fingerprints at distance
d agree on both vectors in at least ``blocks - d`` blocks, so the grid's cells
(one per choice of ``blocks - max_bits`` blocks and the counts in them) bring
every near pair together. The two cuts together tell nearly all of a block's
bits apart, so chance meetings in a cell are rare. In a cell, pairs pass the
Manhattan bound of both vectors and then the exact test.

Dense cells don't emit their pairs: members first link to their cell's leader,
which joins nearly every dense group; only rows that are still in different
components are then paired inside a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .workspace import join_apart, materialise, quoted, ship

LOW = 0x5555555555555555
SEED = 42


def _bits(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """64-bit SimHash of the ASCII-lower-cased words' shingles; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype="<u8")
    else:
        line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
        starts, ends = [0, *(ends[: len(words) - width] + 1).tolist()], ends[width - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), dtype="<u8", count=len(starts))
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)`` per row; texts null or without words get 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), dtype="<u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary")).mapInArrow(run, f"id {kind}, fp long")


def embed(fp: Column) -> Column:
    """The 32 two-bit counts of a fingerprint, packed into a long (0, 1 or 2 in each two bits)."""
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(up).bitwiseAND(_bits(LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(_bits(LOW)), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed count vectors."""
    x = a.bitwiseXOR(b)
    low = x.bitwiseAND(_bits(LOW))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(_bits(LOW)).bitwiseAND(F.bitwise_not(low))
    return F.bit_count(low) + 2 * F.bit_count(high)


def _near(a: str, b: str, max_bits: int) -> Column:
    """The lower bound first, then the exact distance."""
    fa, fb = F.col(a), F.col(b)
    even = manhattan(embed(fa), embed(fb))
    odd = manhattan(embed(F.shiftrightunsigned(fa, 1)), embed(F.shiftrightunsigned(fb, 1)))
    return (F.greatest(even, odd) <= max_bits) & (F.bit_count(fa.bitwiseXOR(fb)) <= max_bits)


def _cells(nodes: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """``(cell, fp)``: each fingerprint in all the grid cells it belongs to."""
    ends = [round(i * 32 / blocks) * 2 for i in range(blocks + 1)]
    even = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    odd = [(1 << (b - 2)) - (1 << a) for a, b in zip(ends, ends[1:])]  # moved down by one bit
    picks = list(combinations(range(blocks), blocks - max_bits))
    masks = F.array(*[F.struct(_bits(sum(even[i] for i in pick)).alias("even"), _bits(sum(odd[i] for i in pick)).alias("odd")) for pick in picks])
    return (
        nodes.select("fp", embed(F.col("fp")).alias("even"), embed(F.shiftrightunsigned("fp", 1)).alias("odd"))
        .select("fp", "even", "odd", F.posexplode(masks).alias("k", "mask"))
        .select(F.xxhash64("k", F.col("even").bitwiseAND(F.col("mask.even")), F.col("odd").bitwiseAND(F.col("mask.odd"))).alias("cell"), "fp")
    )


def link(nodes: DataFrame, max_bits: int = 4, blocks: int = 8) -> DataFrame:
    """Distinct fingerprints ``(fp)`` -> ``(fp, root)`` for those with a near one.

    ``blocks`` trades rows per fingerprint for cell size: 8 give 70 cells keyed by
    about 31 bits of information; corpora of billions of texts take more.
    """
    if not max_bits < blocks <= 32:
        raise ValueError("blocks must lie above max_bits and within 32")
    cells = _cells(nodes, max_bits, blocks)
    crowded = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("leader")).where("n > 1").drop("n")
    members = materialise(join_apart(cells, crowded, "cell"), "members")
    stars = members.where("fp <> leader").where(_near("fp", "leader", max_bits)).select(F.col("fp").alias("u"), F.col("leader").alias("v"))
    rough = connected_components(stars)
    named = join_apart(members.select("cell", "fp"), rough.select(F.col("node").alias("fp"), "root"), "fp", "left").select("cell", "fp", F.coalesce("root", "fp").alias("comp"))
    by_comp = named.groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_comp.groupBy("cell").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    mixed = materialise(join_apart(named, mixed, "cell"), "mixed")
    few = mixed.where("comp <> main").select("cell", F.col("fp").alias("a"), F.col("comp").alias("u"))
    every = mixed.select("cell", F.col("fp").alias("b"), F.col("comp").alias("v"))
    late = join_apart(few, every, "cell").where("u <> v").where(_near("a", "b", max_bits)).select("u", "v")
    merged = connected_components(late)
    up = merged.select(F.col("node").alias("comp"), F.col("root").alias("top"))
    direct = rough.select(F.col("node").alias("fp"), F.col("root").alias("comp"))
    alone = merged.select(F.col("node").alias("fp"), F.col("node").alias("comp"))
    return join_apart(direct.union(alone).distinct(), up, "comp", "left").select("fp", F.coalesce("top", "comp").alias("root")).groupBy("fp").agg(F.min("root").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = 4, width: int = 4, blocks: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id, fp long, component)``.

    ``component`` is the smallest id reachable over links of at most ``max_bits``
    differing bits, the document's own included. Null, empty and blank texts
    share fingerprint 0 and are linked like any other. Rows with a null id keep
    a row and get the smallest non-null id of their component, or null. Repeated
    rows each keep a row. Very long texts are read whole. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    roots = link(nodes.select("fp"), max_bits, blocks)
    grouped = materialise(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep"), "grouped")
    smallest = grouped.groupBy("root").agg(F.min("rep").alias("component"))
    named = grouped.join(smallest, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, max_bits: int = 4, width: int = 4, blocks: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the one whose id is the group's smallest.

    Ids must be unique and non-null for an exact choice; of rows that repeat an
    id every one stays or goes with it, and rows without an id stay.
    """
    found = near_duplicates(docs, max_bits, width, blocks, id_col, text_col)
    gone = materialise(found.where("id <> component").select(F.col("id").alias(id_col)).distinct(), "near-copies")
    return docs.join(gone, id_col, "left_anti").select(*quoted(docs.columns))
