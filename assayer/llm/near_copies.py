"""Near copies by the Jaccard similarity of five-word shingle sets: operator 1 for whole similarities.

Operator 1 comes first: rows whose SimHash fingerprints its grid join links are tested exactly,
on whole texts, with one row of their group. 64-bit fingerprints can't find all pairs of a similarity
of 0.8: such pairs differ in 10 bits on average and in up to 19, while a grid that is complete for
19 of 64 bits brings nearly all pairs together. So what operator 1 leaves apart meets where one of
32 bands of five minimum hashes is equal: a pair of similarity 0.8 has no common band with a
chance of (1 - 0.8^5)^32 = 3e-6, one of 0.9 with 4e-13. What meets is tested exactly,
on both texts.

As in ``simhash``, no cell emits all its pairs: its members are first held against
one of them, the leader, in three rounds with other leaders, where only pairs are tested that
agree in 65 % of 160 minima. Rows that are still in another component than most of their
cell are then held against all of it, in blocks, by a bound that loses nothing: each
set has a bit for each of so many hash buckets, the parity of its shingles there. Two
sets differ in at least as many shingles as bits, and those of similarity 0.8 in at
most a ninth of both sizes together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .graph import connected_components
from .workspace import join_apart, materialise, quoted, ship, trim

SEED, BANDS, ROWS, AGREE, ROUNDS = 42, 32, 5, 0.65, 3
SEVEN, TOP = 0x7F7F7F7F7F7F7F7F, -(1 << 63)  # the low bits of each byte; the highest bit of all
FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ASCII-lower-cased words' shingles; fewer words than ``width`` are one shingle."""
    words = (text or b"").lower().split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, SEED)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), dtype="<u8", count=len(starts)))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the bands, and a byte of each minimum, eight to a number."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(least, (FACTORS * hashes[None, i : i + 2048]).min(axis=1), out=least)
    raw = least.astype("<u8").tobytes()
    bands = np.array([xxhash.xxh64_intdigest(raw[i : i + 8 * ROWS], k) for k, i in enumerate(range(0, len(raw), 8 * ROWS))], dtype="<u8")
    return bands, (least >> np.uint64(20)).astype(np.uint8).view("<i8")


def parities(hashes: np.ndarray) -> bytes:
    """A bit per bucket of the hashes' low bits: whether an odd number fell into it. As many buckets as twice the
    next power of two above the set's size, 512 at least; half as many are the exclusive or of both halves."""
    buckets = max(512, 2 << int(len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def key_of(hashes: np.ndarray) -> int:
    """Equal for equal sets; a signed 64-bit number."""
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), SEED)], "<u8").view("<i8")[0])


def sketched(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, key, n, fp, sig, par, bands)`` per row, ``fp`` being operator 1's fingerprint; rows of equal sets have equal keys."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                keys, sizes, fps, sigs, pars, bands = [], [], [], [], [], []
                for text in (t.as_py() for t in batch.column(1)):
                    hashes = shingle_set(text, width)
                    band, sig = sketch(hashes)
                    fps.append(simhash.fingerprint(text))
                    keys.append(key_of(hashes)), sizes.append(len(hashes)), sigs.append(sig), pars.append(parities(hashes)), bands.append(band)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(x[0]), pa.int32()), pa.array(np.concatenate(x).view("<i8"))) for x in (sigs, bands)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, "<u8").view("<i8")), lists[0], pa.array(pars, pa.binary()), lists[1]], names=["id", "key", "n", "fp", "sig", "par", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary")).mapInArrow(run, f"id {kind}, key long, n int, fp long, sig array<long>, par binary, bands array<long>")


def texts_of(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(key, text)`` for the rows whose ids are in ``wanted (id)``, and for those without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(shingle_set(t.as_py(), width)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0)], names=["key", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = join_apart(rows, wanted, "id", "left_semi").union(rows.where("id IS NULL"))
    return found.select("text").mapInArrow(run, "key long, text binary")


def _differ(a: Column, b: Column) -> Column:
    """In how many of their minima's bytes two sketches differ."""
    total = F.lit(0)
    for i in range(BANDS * ROWS // 8):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        # adding 127 to a byte's low bits carries into its highest unless they are 0; adding TOP too keeps the sum a long
        carried = (x.bitwiseAND(F.lit(SEVEN)) + F.lit(SEVEN + TOP)).bitwiseXOR(F.lit(TOP))
        total = total + F.bit_count(carried.bitwiseOR(x).bitwiseAND(F.lit(~SEVEN)))
    return total


def _alike(pairs: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """``(u, v)`` of those pairs ``(a, b, u, v)`` of keys whose whole sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        key, held = None, np.empty(0)
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4)):
                if b != key:  # rows of one b come together
                    key, held = b, shingle_set(y.as_py(), width)
                mine = shingle_set(x.as_py(), width)
                common = len(np.intersect1d(mine, held, assume_unique=True))
                keep.append(common >= least * (len(mine) + len(held) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    whole = join_apart(join_apart(pairs, texts.toDF("a", "x"), "a"), texts.toDF("b", "y"), "b").select("b", "u", "v", "x", "y")
    return whole.mapInArrow(run, "u long, v long").distinct()


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(cell, key, n, sig, comp)`` of the cells whose members are in several components."""
    named = join_apart(members, labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    named = materialise(named.select("cell", "key", "n", "sig", "comp"), "named")
    several = named.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("cell")
    return materialise(join_apart(named, several, "cell", "left_semi"), "mixed")


def _pairs(joined: DataFrame, least: float) -> DataFrame:
    """Distinct ``(a, b, u, v)`` with ``a < b`` of rows ``(x, y)`` in different components whose sizes and minima allow the similarity."""
    nx, ny = F.col("x.n"), F.col("y.n")
    fit = joined.where("x.comp <> y.comp").where(F.least(nx, ny) >= F.greatest(nx, ny) * least)
    fit = fit.where(_differ(F.col("x.sig"), F.col("y.sig")) <= int((1 - AGREE) * BANDS * ROWS))
    first = F.col("x.key") < F.col("y.key")
    low, high = F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("y")).otherwise(F.col("x"))
    return fit.select(low["key"].alias("a"), high["key"].alias("b"), low["comp"].alias("u"), high["comp"].alias("v")).dropDuplicates(["a", "b"])


def close_pairs(a: dict, b: dict, least: float, room: int = 1 << 24) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the rows ``(n, comp, par)`` in different components whose sizes and parities allow the similarity.

    Rows of one level, as many parity bits, are compared at a time; a level apart, the longer one is folded.
    Sets of the similarity are never more than a level apart. ``room`` bounds the bytes of a comparison.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    widths = [np.array([len(p) for p in side["par"]]) for side in (a, b)]
    for wa in np.unique(widths[0]):
        for wb in (wa // 2, wa, wa * 2):
            ia, ib, w = np.flatnonzero(widths[0] == wa), np.flatnonzero(widths[1] == wb), int(min(wa, wb))
            if not len(ia) or not len(ib):
                continue
            bits = []
            for side, rows, own in ((a, ia, wa), (b, ib, wb)):
                m = np.frombuffer(b"".join(side["par"][i] for i in rows), dtype=np.uint64).reshape(len(rows), -1)
                bits.append(m if own == w else m[:, : w // 8] ^ m[:, w // 8 :])
            step = max(1, room // (len(ib) * w))
            for i in range(0, len(ia), step):
                x = ia[i : i + step]
                na, nb = a["n"][x][:, None], b["n"][ib][None, :]
                fit = (a["comp"][x][:, None] != b["comp"][ib][None, :]) & (np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9)
                apart = np.bitwise_count(bits[0][i : i + step, None, :] ^ bits[1][None, :, :]).sum(axis=2, dtype=np.int64)
                fit &= apart * (1 + least) <= (na + nb) * (1 - least) + 1e-9
                u, v = np.nonzero(fit)
                found.append((x[u], ib[v]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _left_pairs(mixed: DataFrame, parity: DataFrame, least: float, block_bytes: int = 1 << 22) -> DataFrame:
    """Distinct ``(a, b, u, v)`` of the rows outside their cell's largest component with the cell's others, where the bounds allow.

    A cell's rows are packed into blocks of about ``block_bytes``, and blocks of one cell meet, so
    that rows of pairs are made only for what the bounds let through.
    """
    sizes = mixed.groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("cell").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"))
    rows = materialise(join_apart(join_apart(mixed.select("cell", "key", "n", "comp"), parity, "key"), main, "cell"), "left")
    blocks = rows.groupBy("cell").agg(F.ceil(F.sum(F.octet_length("par") + 64) / block_bytes).alias("blocks"))
    dealt = join_apart(rows, blocks, "cell").withColumn("block", F.pmod(F.xxhash64("key", F.lit(9)), F.col("blocks")))
    pack = lambda some, name: some.groupBy("cell", "block").agg(F.collect_list(F.struct("key", "n", "comp", "par")).alias(name)).drop("block")

    def side(lists: pa.ListScalar) -> dict:
        values = lists.values
        return {**{c: values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "comp")}, "par": values.field("par").to_pylist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(batch.column(0), batch.column(1)):
                x, y = side(asked), side(held)
                i, j = close_pairs(x, y, least)
                for k in range(0, len(i), 1 << 16):
                    p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    first = x["key"][p] < y["key"][q]
                    ends = [np.where(first, one, other) for c in ("key", "comp") for one, other in ((x[c][p], y[c][q]), (y[c][q], x[c][p]))]
                    yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], names=["a", "b", "u", "v"])

    met = join_apart(pack(dealt.where("comp <> main"), "asked"), pack(dealt, "held"), "cell").select("asked", "held")
    return met.mapInArrow(run, "a long, b long, u long, v long").dropDuplicates(["a", "b"])


def fingerprint_pairs(nodes: DataFrame, least: float) -> DataFrame:
    """``(a, b, u, v)`` of distinct keys ``(key, n, fp)``: each row of a group that operator 1 makes with the group's
    smallest key, where the sizes allow the similarity."""
    roots = simhash.link(nodes.select("fp").distinct())
    grouped = materialise(join_apart(nodes, roots, "fp", "left").select("key", "n", F.coalesce("root", "fp").alias("root")), "fingerprint-groups")
    leaders = grouped.groupBy("root").agg(F.min("key").alias("a"), F.min_by("n", "key").alias("na"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = join_apart(grouped, leaders, "root").where("key <> a").where(F.least("n", "na") >= F.greatest("n", "na") * least)
    return met.select("a", F.col("key").alias("b"), F.col("a").alias("u"), F.col("key").alias("v"))


def link(nodes: DataFrame, texts, least: float, width: int) -> DataFrame:
    """Distinct keys ``(key, n, fp, sig, par, bands)`` -> ``(key, comp)`` for keys that have a near one.

    ``texts(keys)`` gives ``(key, text)`` for a table of keys.
    """
    cells = nodes.select("key", "n", F.posexplode("bands").alias("k", "band")).select(F.xxhash64("k", "band").alias("cell"), "key", "n")
    crowded = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("cell")
    members = materialise(join_apart(cells, crowded, "cell", "left_semi"), "cells")
    members = materialise(join_apart(members, nodes.select("key", "sig"), "key"), "members")
    alike = materialise(fingerprint_pairs(nodes.select("key", "n", "fp"), least), "fingerprint-pairs")
    keys = members.select("key").union(alike.select("a")).union(alike.select("b"))
    held = materialise(texts(keys.distinct()), "texts")
    labels = connected_components(materialise(_alike(alike, held, least, width), "alike")).toDF("key", "comp")
    tested = alike.select("a", "b")
    row = F.struct("key", "n", "sig", "comp")
    for turn in range(ROUNDS + 1):
        mixed = _mixed(members, labels)
        if turn < ROUNDS:  # everyone with the cell's leader
            order = F.col("key") if turn == 0 else F.xxhash64("key", "cell", F.lit(turn))
            leaders = mixed.groupBy("cell").agg(F.min_by(row, F.struct(order, "key")).alias("y"))
            pairs = _pairs(join_apart(mixed.select("cell", row.alias("x")), leaders, "cell"), least)
        else:  # everyone outside the cell's largest component with all of the cell
            pairs = _left_pairs(mixed, nodes.select("key", "par"), least)
        pairs = materialise(join_apart(pairs, tested, ["a", "b"], "left_anti"), "candidates")
        near = materialise(_alike(pairs, held, least, width), "alike")
        tested = tested.union(pairs.select("a", "b"))
        merged = connected_components(near)
        moved = join_apart(labels, merged.toDF("comp", "top"), "comp", "left").select("key", F.coalesce("top", "comp").alias("comp"))
        alone = join_apart(merged.toDF("key", "comp"), labels, "key", "left_anti")
        labels = materialise(moved.union(alone), "labels")
    return labels


def drop_near_copies(docs: DataFrame, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group that links of similarity ``least`` or more join: the one of the smallest id.

    Null, empty and blank texts are equal, and a text of fewer words than
    ``width`` is one shingle. Of rows that repeat an id every one stays or goes
    with it, and rows without an id stay. Very long texts are compared whole;
    other columns pass through, whatever their names; an empty table stays empty.
    """
    rows = materialise(sketched(docs, width, id_col, text_col), "sketched")
    nodes = materialise(rows.groupBy("key").agg(F.min("id").alias("rep"), F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("n", "sig", "par", "bands"))), "nodes")

    def texts(keys: DataFrame) -> DataFrame:
        return texts_of(docs, join_apart(nodes, keys, "key", "left_semi").where("rep IS NOT NULL").select(F.col("rep").alias("id")).distinct(), width, id_col, text_col)

    labels = link(nodes.select("key", "n", "fp", "sig", "par", "bands"), texts, least, width)
    grouped = materialise(join_apart(nodes.select("key", "rep"), labels, "key", "left").select("key", F.coalesce("comp", "key").alias("root"), "rep"), "grouped")
    smallest = grouped.groupBy("root").agg(F.min("rep").alias("component"))
    gone = join_apart(rows.select("id", "key"), join_apart(grouped, smallest, "root").select("key", "component"), "key")
    gone = gone.where("id <> component").select(F.col("id").alias(id_col)).distinct()
    return join_apart(docs, materialise(gone, "near-copies"), id_col, "left_anti").select(*quoted(docs.columns))
