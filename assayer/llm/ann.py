"""Nearest neighbours by inner product over an additive-quantisation index.

A vector is stored as its norm and one code per codebook; its direction is
approximated by the sum of the coded vectors, all of full dimension. Codes come
from a beam search. A query scores codes through a table of its inner products
with all codebook vectors. Only codes meet the blocks of queries; each query's
best of the whole index are then scored exactly where the original vectors are.
An entry also keeps the length of what its codes leave, so that entries are
ordered by what their score may be; a query whose last candidate may still be as
near as the ones found gets a longer list, until none may.

Rows of equal vectors are one entry of the index, with the smallest ids among
them, so that a vector that very many rows share takes the place of one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialise, ship


@dataclass(frozen=True)
class AdditiveQuantiser:
    books: np.ndarray  # codebook, entry, dimension; float32
    widest: float = 1.0  # share of what codes leave, in squares, that may lie along one direction

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[c] for book, c in zip(self.books, codes.T))

    def encode(self, x: np.ndarray, beam: int = 4) -> np.ndarray:
        """Codes of unit vectors: the best sums found when ``beam`` partial sums are kept per codebook."""
        out = np.empty((len(x), len(self.books)), dtype=np.uint8)
        norms = (self.books**2).sum(axis=2)
        for i in range(0, len(x), 256):  # so that the costs of all partial sums stay in the cache
            part = x[i : i + 256].astype(np.float32)
            residual = part[:, None, :]
            error = (part**2).sum(axis=1)[:, None]
            codes = np.empty((len(part), 1, 0), dtype=np.uint8)
            rows = np.arange(len(part))[:, None]
            for book, norm in zip(self.books, norms):
                cost = error[:, :, None] + norm - 2 * residual @ book.T
                flat = cost.reshape(len(part), -1)
                k = min(beam, flat.shape[1])
                best = np.argpartition(flat, k - 1, axis=1)[:, :k]
                parent, entry = best // len(book), best % len(book)
                error = np.take_along_axis(flat, best, axis=1)
                residual = residual[rows, parent] - book[entry]
                codes = np.concatenate([codes[rows, parent], entry[:, :, None].astype(np.uint8)], axis=2)
            out[i : i + 256] = codes[rows[:, 0], error.argmin(axis=1)]
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products ``[codebook, query, entry]``."""
        return np.einsum("qd,mkd->mqk", queries.astype(np.float32), self.books, optimize=True)


def train(x: np.ndarray, books: int = 16, entries: int = 256, rounds: int = 6, refine: int = 2, seed: int = 11) -> AdditiveQuantiser:
    """Codebooks for unit vectors: k-means on what earlier ones leave, then all refitted
    together by least squares to beam-searched codes."""
    rng = np.random.default_rng(seed)
    entries = min(entries, len(x))
    x = x.astype(np.float32)
    residual, made = x.copy(), []
    for _ in range(books):
        centres = residual[rng.choice(len(x), entries, replace=False)]
        for _ in range(rounds):
            near = (residual @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, residual)
            count = np.bincount(near, minlength=entries)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], residual[rng.choice(len(x), entries)])
        near = (residual @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
        residual = residual - centres[near]
        made.append(centres)
    model = AdditiveQuantiser(np.stack(made))
    for _ in range(refine):
        model = AdditiveQuantiser(_refitted(model.books, model.encode(x), x))
    left = x - model.decode(model.encode(x))
    e = np.linalg.eigvalsh((left.T @ left).astype(np.float64))
    return AdditiveQuantiser(model.books, float(e[-1] / e.sum()) if e.sum() > 0 else 1.0)


def _refitted(books: np.ndarray, codes: np.ndarray, x: np.ndarray, steps: int = 30) -> np.ndarray:
    """Codebooks whose coded sums fit ``x`` best by least squares, held to the old ones by a ridge:
    conjugate gradients, so that the normal matrix of all entries is never made."""
    sorted_ = [(o := np.argsort(c, kind="stable"), f := np.flatnonzero(np.concatenate([[True], np.diff(c[o]) != 0])), c[o][f]) for c in codes.T]
    ridge = np.float32(0.5 + len(x) * 1e-4)

    def summed(b: np.ndarray) -> np.ndarray:
        return sum(book[c] for book, c in zip(b, codes.T))

    def spread(y: np.ndarray) -> np.ndarray:
        out = np.zeros_like(books)
        for book, (order, firsts, entries) in zip(out, sorted_):
            book[entries] = np.add.reduceat(y[order], firsts, axis=0)
        return out

    b = books.copy()
    left = spread(x - summed(b))  # the ridge pulls towards where this starts
    along, size = left.copy(), float(np.vdot(left, left))
    for _ in range(steps):
        if size < 1e-10:
            break
        image = spread(summed(along)) + ridge * along
        step = np.float32(size / float(np.vdot(along, image)))
        b += step * along
        left -= step * image
        before, size = size, float(np.vdot(left, left))
        along = left + np.float32(size / before) * along
    return b


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(row, id, dim, vec binary)``: float64 vectors that take part, rows numbered. Null ids, null or zero
    vectors and those with null or non-finite components are left out."""
    ship(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten()
            x = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = lambda y: np.diff(np.concatenate([[0], np.cumsum(y)])[ends])
            good = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & (sums(~np.isfinite(x)) == 0) & (sums(x != 0) > 0)
            at = np.flatnonzero(good)
            x = (x + 0.0).astype("<f8")  # minus zero is zero
            bodies = [x[ends[i] : ends[i + 1]].tobytes() for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(row + at), batch.column(0).take(pa.array(at)), pa.array(sizes[at], pa.int32()), pa.array(bodies, pa.binary())], names=["row", "id", "dim", "vec"])
            row += batch.num_rows

    raw = table.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    return materialise(raw.mapInArrow(run, "row long, id long, dim int, vec binary"), "vectors")


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """``(node, vec, members)``: each vector once, with its ``most`` rows ``(id, row)`` of smallest ids; ``node`` is the first's row."""
    order = Window.partitionBy("vec").orderBy("id", "row")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    grouped = few.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("members"))
    return materialise(grouped.select(F.col("members")[0]["row"].alias("node"), "vec", "members"), "distinct")


def _bytes(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """The bytes of a binary column's rows, all of one length, as a matrix that reads them where Arrow holds them."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(held):
        return np.empty((0, 0), dtype=kind)
    _, offsets, data = held.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(held), -1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return _bytes(column, "<f8")


def build_index(vectors: DataFrame, sample_rows: int = 8192, books: int = 32, entries: int = 256) -> tuple[AdditiveQuantiser, DataFrame]:
    """The quantiser, fitted to at most ``sample_rows`` vectors in order of a hash of their
    node, and the index ``(node, codes, norm, error)`` of every vector ``(node, vec)``, of which there is one at least."""
    x = _matrix(vectors.orderBy(F.xxhash64("node"), "node").limit(sample_rows).select("vec").toArrow().column("vec"))
    model = train(x / np.linalg.norm(x, axis=1, keepdims=True), books, entries)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                norm = np.linalg.norm(x, axis=1)
                unit = x / norm[:, None]
                codes = shared.value.encode(unit)
                error = norm * np.linalg.norm(unit - shared.value.decode(codes), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(error)], names=["node", "codes", "norm", "error"])

    return model, materialise(vectors.select("node", "vec").mapInArrow(run, "node long, codes binary, norm double, error double"), "index")


def _best(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` largest of each row's values, rows ascending; equal values by column."""
    order = np.lexsort((columns, -values, rows))
    ahead = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
    order = order[ahead < n]
    return rows[order], columns[order], values[order]


def approximate(model: AdditiveQuantiser, queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, n: int, error: np.ndarray | None = None, step: int = 16_384) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, column, value)`` of each query's ``n`` best entries by table lookups, of equal ones the first; a value is what the
    score may be: two standard deviations along the direction in which ``error``, the length that codes leave, is widest are added.

    Entries are taken ``step`` at a time, and only those above the ``n``-th value so far are looked at again.
    """
    found = []
    room = 1e-6 * norm + (0 if error is None else 2 * math.sqrt(model.widest) * error)
    norm, room, codes = norm.astype(np.float32)[:, None], room.astype(np.float32)[:, None], np.ascontiguousarray(codes.T)
    lengths = np.linalg.norm(queries, axis=1).astype(np.float32)
    for i in range(0, len(queries), 32):  # so that tables and a step's scores stay in the cache
        tables = np.ascontiguousarray(model.tables(queries[i : i + 32]).transpose(0, 2, 1))
        least = np.full(tables.shape[2], -np.inf, dtype=np.float32)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        for j in range(0, len(norm), step):
            scores = np.zeros((len(norm[j : j + step]), len(least)), dtype=np.float32)
            looked = np.empty_like(scores)
            for table, code in zip(tables, codes[:, j : j + step].astype(np.intp)):
                scores += np.take(table, code, axis=0, out=looked, mode="clip")
            scores *= norm[j : j + step]
            scores += lengths[i : i + 32] * room[j : j + step]
            first = not len(best[0]) and len(scores) > n
            column, row = np.nonzero(scores >= np.partition(scores.T, -n, axis=1)[:, -n] if first else scores > least)
            best = _best(*(np.concatenate(x) for x in zip(best, (row, column + j, scores[column, row]))), n)
            last = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == n - 1)
            least[best[0][last]] = best[2][last]
        found.append((best[0] + i, *best[1:]))
    return tuple(np.concatenate(x) for x in zip(*found))


def candidates(model: AdditiveQuantiser, index: DataFrame, queries: DataFrame, rerank: int, block_rows: int, query_rows: int) -> DataFrame:
    """``(query, node, near)``: the ``rerank`` best entries of the whole index for each of ``queries (node, vec)``.

    A block of codes and a block of queries are one group, whose lists are ``query_rows`` times ``rerank`` rows
    at most however large the table; fewer queries are dealt over up to eight blocks.
    """
    entries, asking = index.count(), queries.count()
    blocks, query_blocks = max(1, math.ceil(entries / block_rows)), max(1, math.ceil(asking / query_rows), min(8, math.ceil(asking / 256)))
    where = lambda n: F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select("*", where(blocks).alias("block"), each(query_blocks).alias("query_block"))
    right = queries.select("node", "vec", where(query_blocks).alias("query_block"), each(blocks).alias("block"))
    shared = index.sparkSession.sparkContext.broadcast(model)

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "near": pa.array([], pa.float32())})
        held = held.sort_by("node")
        rows, columns, values = approximate(shared.value, _matrix(asked.column("vec")), _bytes(held.column("codes"), "u1"), held.column("norm").to_numpy(), rerank, held.column("error").to_numpy())
        return pa.table({"query": asked.column("node").to_numpy()[rows], "node": held.column("node").to_numpy()[columns], "near": values})

    found = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInArrow(run, "query long, node long, near float")
    order = Window.partitionBy("query").orderBy(F.desc("near"), "node")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rerank).select("query", "node", "near")


def exact(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, keep: int, block_rows: int, list_rows: int = 32_768) -> DataFrame:
    """``(query, node, score)``: the ``keep`` best of each query's candidates by their original vectors, in each
    block of ``vectors (node, vec, members)``; ties go to the smaller first id.

    A query goes once to each block of vectors in which it has candidates. Blocks
    that very many queries ask for are sent out once per ``list_rows`` of them.
    """
    blocks = max(1, math.ceil(vectors.count() / block_rows))
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block")
    lists = materialise(pairs.select("query", "node", block).groupBy("query", "block").agg(F.collect_list("node").alias("nodes")), "lists")
    chunks = lists.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / list_rows).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int").alias("chunk")
    asked = lists.join(chunks, "block").select("block", chunk, "query", "nodes").join(queries.select(F.col("node").alias("query"), F.col("vec").alias("asked")), "query")
    held = vectors.select("node", "vec", block, F.col("members")[0]["id"].alias("id")).join(chunks, "block").select("node", "vec", "id", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def run(here: pa.Table, wanted: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [np.empty(0, np.int64)], "node": [np.empty(0, np.int64)], "score": [np.empty(0)]}
        if here.num_rows and wanted.num_rows:
            here = here.sort_by("node")
            nodes, ids, x = here.column("node").to_numpy(), here.column("id").to_numpy(), _matrix(here.column("vec"))
            for query, mine, body in zip(wanted.column("query").to_pylist(), wanted.column("nodes"), wanted.column("asked").to_pylist()):
                at = np.searchsorted(nodes, np.sort(mine.values.to_numpy()))
                score = (x[at] * np.frombuffer(body, dtype="<f8")).sum(axis=1)
                best = np.lexsort((ids[at], -score))[:keep]
                out["query"].append(np.full(len(best), query)), out["node"].append(nodes[at[best]]), out["score"].append(score[best])
        return pa.table({k: np.concatenate(v) for k, v in out.items()})

    return held.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(run, "query long, node long, score double")


def settled(model: AdditiveQuantiser, index: DataFrame, vectors: DataFrame, queries: DataFrame, keep: int, rerank: int, block_rows: int, query_rows: int, exact_rows: int) -> DataFrame:
    """``(query, node, score)`` with the ``keep`` best vectors of each query among them.

    A query whose list ends at an entry that may be as near as the last one kept is asked again with
    a list eight times as long, in smaller blocks of queries, so that a group holds no more rows than before.
    """
    entries, most, asked, parts = index.count(), rerank, queries, []
    last = Window.partitionBy("query").orderBy(F.desc("score"))
    while True:
        fewer = lambda rows: max(1, rows * rerank // most)  # noqa: B023, E731
        pairs = materialise(candidates(model, index, asked, most, block_rows, fewer(query_rows)), "candidates")
        scored = materialise(exact(pairs, vectors, asked, keep, exact_rows, fewer(32_768)), "scored")
        if most >= entries:
            return reduce(DataFrame.union, [*parts, scored])
        kth = scored.withColumn("n", F.row_number().over(last)).where(F.col("n") == keep).select("query", F.col("score").alias("kth"))
        ends = pairs.groupBy("query").agg(F.min("near").alias("end"))
        more = materialise(ends.join(kth, "query", "left").where("kth IS NULL OR end >= kth").select(F.col("query").alias("node")), "unsettled")
        parts.append(scored.join(more.withColumnRenamed("node", "query"), "query", "left_anti"))
        if more.isEmpty():
            return reduce(DataFrame.union, parts)
        most, asked = most * 8, queries.join(more, "node", "left_semi")


def nearest(table: DataFrame, every: int = 20, k: int = 20, rerank: int = 192, block_rows: int = 131_072, query_rows: int = 4096, block_bytes: int = 32 << 20, id_col: str = "vec_id", vector_col: str = "embedding", **fitting) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` vectors of largest inner product for each
    row whose id is divisible by ``every``, the row itself left out; ties go to smaller ids.

    See ``usable_vectors`` for rows that take no part. Every other row counts, also
    those that repeat an id or a vector; a query that repeats an id gets its own
    ``k`` rows. Vectors of different lengths don't meet: a row is searched among
    those of its own length. Original vectors are compared in blocks of ``block_bytes``
    at most, whatever their length. ``rerank`` is the number of candidates that a query gets at first,
    see ``settled``. With fewer candidates than ``k`` all are returned;
    none give no rows. Other columns are ignored, whatever their names.
    """
    rows = usable_vectors(table, id_col, vector_col)
    found = []
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):
        mine = rows.where(F.col("dim") == dim)
        vectors = distinct_vectors(mine, k + 1)
        asking = mine.where(F.pmod("id", F.lit(every)) == 0)
        asking = materialise(asking.join(vectors.select("vec", "node"), "vec").select("id", "row", F.col("node").alias("query")), "queries")
        queries = vectors.join(asking.select(F.col("query").alias("node")).distinct(), "node", "left_semi").select("node", "vec")
        model, index = build_index(vectors, **fitting)
        scored = settled(model, index, vectors, queries, k + 1, rerank, block_rows, query_rows, max(1, min(block_rows, block_bytes // (8 * max(1, dim)))))
        # The k + 1 best vectors hold the k best rows, as the row itself is one of theirs at most.
        first = F.col("members")[0]["id"]
        near = scored.join(vectors.select("node", "members"), "node")
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), first))).where(F.col("n") <= k + 1)
        listed = materialise(near.groupBy("query").agg(F.collect_list(F.struct("score", "members")).alias("near")), "near")
        pairs = asking.join(listed, "query").select("id", "row", F.inline("near")).select("id", "row", "score", F.inline("members").alias("vec_id", "vec_row"))
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "vec_row")
        ranked = pairs.where("row <> vec_row").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", "score"))
    if not found:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found)
