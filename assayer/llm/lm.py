"""Gated recurrent language model with a class-factored output, in numpy.

Words are head words (the most frequent ones, dealt over classes of equal size)
or tail words, dealt over buckets by their last bytes. The recurrent state gives
a distribution over classes and buckets and, in a class, over its words; in a
bucket a word has its add-one share of training tokens. So every text has a
probability, and the tail's part is a join of its words with corpus counts.

Training documents are dealt over shards by a hash of their id and put in order
there, so that neither the input's partitions nor the cluster change the result.
Each shard continues from the same weights by truncated backpropagation, and the
weights are averaged by tokens. The state is carried across windows in training
and scoring alike, and starts anew only with a new document.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import last_bytes, split_words, text_runs
from .workspace import materialise, ship

END = b"\n"  # no word holds white space
HIDDEN, CLASSES, PER_CLASS, BUCKETS = 24, 16, 64, 48
HEAD, OUTPUTS = CLASSES * PER_CLASS, CLASSES + BUCKETS
INPUTS = HEAD + BUCKETS + 1  # the last one starts a document
STEP = 16 << 20  # bytes of text laid out in lanes together; the more, the fuller the lanes beside a long document


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def words_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


@dataclass
class Vocabulary:
    """``places``: word to rank, for the words that are broadcast; the first ``HEAD`` are the head.
    ``counts`` by rank, tokens and words of each bucket's tail, and the training totals N and V."""

    places: dict[bytes, int]
    counts: np.ndarray
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray
    tokens: int
    words: int

    def __post_init__(self):
        ordered = sorted(self.places, key=self.places.get)
        rank = np.arange(len(ordered))
        self.codes = np.where(rank < HEAD, rank, HEAD + np.array([bucket_of(w) for w in ordered], dtype=np.int64)).astype(np.int16)
        self.logs = np.log10(self.counts + 1.0)

    def bucket_logs(self) -> np.ndarray:
        return np.log10(self.bucket_tokens + self.bucket_words + 1.0)


def new_weights(vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights whose output is the unigram model, before any training."""
    rng = np.random.default_rng(seed)
    head = np.zeros(HEAD)
    known = min(HEAD, len(vocabulary.counts))
    head[:known] = vocabulary.counts[:known]
    grouped = head.reshape(CLASSES, PER_CLASS)
    mass = np.concatenate([grouped.sum(axis=1), vocabulary.bucket_tokens]) + 0.5
    return {
        "inputs": np.asfortranarray(rng.normal(0, 0.1, (INPUTS, 3 * HIDDEN)), np.float32),
        "state": rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "classes": np.zeros((HIDDEN, OUTPUTS), np.float32),
        "class_bias": np.log(mass / mass.sum()).astype(np.float32),
        "words": np.zeros((CLASSES, HIDDEN, PER_CLASS), np.float32),
        "word_bias": np.where(np.arange(HEAD).reshape(CLASSES, PER_CLASS) < known, np.log(grouped + 0.5), -30.0).astype(np.float32),
    }


def _step(weights: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray):
    """Update gate, reset gate, the candidate's recurrent part, the candidate and the new state of each lane,
    from ``x`` (what the input adds; overwritten) and the state ``h``. Arrays are ``[lane, unit]``, best as
    transposed views of ``[unit, lane]``, whose rows are worked on at once."""
    x, h = x.T, h.T
    g = weights["state"].T @ h
    gates, n, gn = x[: 2 * HIDDEN], x[2 * HIDDEN :], g[2 * HIDDEN :]
    gates += g[: 2 * HIDDEN]
    gates *= 0.5  # 1 / (1 + exp(-v)) is (1 + tanh(v / 2)) / 2
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    n += gates[HIDDEN:] * gn
    np.tanh(n, out=n)
    new = h - n
    new *= gates[:HIDDEN]
    new += n
    return gates[:HIDDEN].T, gates[HIDDEN:].T, gn.T, n.T, new.T


def _chosen(logits: np.ndarray, row: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability of one row per column, with the exponentials and their sums. States lie within -1 and 1;
    unless that keeps all logits small (``bounded``), a cut guards the exponential."""
    picked = logits[row, np.arange(len(row))]
    e = np.exp(logits if bounded else np.minimum(logits, 80.0, out=logits), out=logits)
    total = np.ones(len(e), e.dtype) @ e
    return picked - np.log(total), e, total


def _with_bias(weights: dict[str, np.ndarray], name: str, bias: str) -> tuple[np.ndarray, bool]:
    """Weights with the bias as the row of one more unit that is always 1, and whether no logit can pass 80."""
    both = np.concatenate([weights[name], np.expand_dims(weights[bias], -2)], axis=-2)
    return both, float(np.abs(both).sum(axis=-2).max()) < 80


def _output(weights: dict[str, np.ndarray], h: np.ndarray, code: np.ndarray, grads: dict[str, np.ndarray] | None, weight: float = 1.0):
    """Natural-log probability of each code (for the tail: of its bucket) after states ``h [token, unit]``; with
    ``grads`` adds the loss's gradients to them and returns that of ``h`` too."""

    def back(e: np.ndarray, total: np.ndarray, row: np.ndarray) -> np.ndarray:
        e *= weight / total
        e[row, np.arange(len(row))] -= weight
        return e

    h = np.concatenate([h.T, np.ones((1, len(h)), h.dtype)])
    outer, bounded = _with_bias(weights, "classes", "class_bias")
    kind = np.where(code < HEAD, code // PER_CLASS, CLASSES + code - HEAD)
    order = np.argsort(kind.astype(np.uint8), kind="stable")  # classes first, so that each one's tokens are a slice
    kind, h = kind[order], np.take(h, order, axis=1)
    out, e, total = _chosen(outer.T @ h, kind, bounded)
    dh = None
    if grads is not None:
        d = back(e, total, kind)
        g = h @ d.T
        grads["classes"] += g[:-1]
        grads["class_bias"] += g[-1]
        dh = weights["classes"] @ d
    cuts = np.searchsorted(kind, np.arange(CLASSES + 1))
    word = code[order[: cuts[-1]]] % PER_CLASS
    inside, bounded = _with_bias(weights, "words", "word_bias")
    for c in range(CLASSES):
        at = slice(cuts[c], cuts[c + 1])
        if cuts[c] < cuts[c + 1]:
            inner, e, total = _chosen(inside[c].T @ h[:, at], word[at], bounded)
            out[at] += inner
            if grads is not None:
                d = back(e, total, word[at])
                g = h[:, at] @ d.T
                grads["words"][c] += g[:-1]
                grads["word_bias"][c] += g[-1]
                dh[:, at] += weights["words"][c] @ d
    back_to = np.empty_like(order)
    back_to[order] = np.arange(len(order))
    return out[back_to], None if dh is None else np.take(dh, back_to, axis=1).T


def lanes_of(codes: np.ndarray, lengths: np.ndarray, most_lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid end to end in lanes of nearly equal length, the longest lane first: ``code``, ``document``
    (-1: none) and ``previous`` code (the start marker for a first word), each ``[time, lane]``."""
    lanes = max(1, min(most_lanes, len(lengths)))
    ends, placed = np.zeros(lanes, dtype=np.int64), []
    heap = [(0, i) for i in range(lanes)]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for d in np.argsort(-lengths, kind="stable").tolist():
        used, lane = heapq.heappop(heap)
        placed.append((d, lane, used))
        ends[lane] = used + lengths[d]
        heapq.heappush(heap, (int(ends[lane]), lane))
    seat = np.empty(lanes, dtype=np.int64)
    seat[np.argsort(-ends, kind="stable")] = np.arange(lanes)
    shape = (int(ends.max()), lanes)
    code, document, previous = np.zeros(shape, np.int16), np.full(shape, -1, np.int32), np.full(shape, INPUTS - 1, np.int16)
    for d, lane, at in placed:
        n, lane = int(lengths[d]), seat[lane]
        part = codes[starts[d] : starts[d] + n]
        code[at : at + n, lane] = part
        document[at : at + n, lane] = d
        previous[at + 1 : at + n, lane] = part[:-1]
    return code, document, previous


def _inputs(weights: dict[str, np.ndarray], before: np.ndarray) -> np.ndarray:
    """What the codes of ``before [time, lane]`` add, ``[time, unit, lane]``; best with ``inputs`` in column order."""
    table = weights["inputs"].T
    out = np.empty((len(before), len(table), before.shape[1]), table.dtype)
    for t, codes in enumerate(before):
        np.take(table, codes, axis=1, out=out[t], mode="clip")
    return out


def _by_unit(x: np.ndarray) -> np.ndarray:
    """``[time, unit, lane]`` as ``[unit, token]``."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


def score_lanes(weights: dict[str, np.ndarray], code: np.ndarray, document: np.ndarray, previous: np.ndarray, documents: int, window: int = 32) -> np.ndarray:
    """Summed natural-log probabilities of each document."""
    out = np.zeros(documents)
    h, kind = np.zeros((HIDDEN, code.shape[1]), weights["state"].dtype), weights["state"].dtype
    starts = (previous == INPUTS - 1).any(axis=1)
    for t0 in range(0, len(code), window):
        lanes = int((document[t0] >= 0).sum())  # those that are not at their end
        before, h = previous[t0 : t0 + window, :lanes], np.ascontiguousarray(h[:, :lanes])
        x, states = _inputs(weights, before), np.empty((len(before), HIDDEN, lanes), kind)
        for t in range(len(before)):
            if starts[t0 + t]:
                h = h * (before[t] != INPUTS - 1)
            h = _step(weights, x[t].T, h.T)[-1].T
            states[t] = h
        here = document[t0 : t0 + window, :lanes].ravel()
        codes, flat = code[t0 : t0 + window, :lanes].ravel(), _by_unit(states)
        live = here >= 0
        if not live.all():
            here, codes, flat = here[live], codes[live], flat[:, live]
        logs, _ = _output(weights, flat.T, codes, None)
        out += np.bincount(here, weights=logs, minlength=documents)
    return out


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.steps = weights, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def apply(self, grads: dict[str, np.ndarray], share: float = 1.0) -> None:
        """A step; ``share`` of its usual length where a window holds few tokens. Overwrites ``grads``."""
        self.steps += 1
        flat = (g.ravel(order="K") for g in grads.values())  # no copies, whatever the order
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in flat))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        rate = self.rate * share * math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k, g in grads.items():
            first, second = self.first[k], self.second[k]
            g *= scale
            first *= 0.9
            second *= 0.99
            part = g * 0.1
            first += part
            g *= part
            g *= 0.1
            second += g
            np.sqrt(second, out=g)
            g += 1e-6
            np.divide(first, g, out=g)
            g *= rate
            self.weights[k] -= g


def _add_by_code(table: np.ndarray, codes: np.ndarray, units: np.ndarray) -> None:
    """Add each token's column of ``units [unit, token]`` to its code's row of ``table``, best in column order."""
    codes = codes.astype(np.intp)
    for k, values in enumerate(units):
        table[:, k] += np.bincount(codes, weights=values, minlength=len(table))


def train_lanes(adam: Adam, code: np.ndarray, document: np.ndarray, previous: np.ndarray, window: int = 32) -> float:
    """One pass of truncated backpropagation; the state goes on from window to window. The mean loss."""
    weights = adam.weights
    state, kind = weights["state"], weights["state"].dtype
    starts = (previous == INPUTS - 1).any(axis=1)
    h = np.zeros((HIDDEN, code.shape[1]), kind)
    loss = count = 0.0
    for t0 in range(0, len(code), window):
        lanes = int((document[t0] >= 0).sum())
        before, h = previous[t0 : t0 + window, :lanes], np.ascontiguousarray(h[:, :lanes])
        n = len(before)
        x = _inputs(weights, before)  # becomes the gates and the candidate
        old, gn, new, keep = (*(np.empty((n, HIDDEN, lanes), kind) for _ in range(3)), {})
        for t in range(n):
            if starts[t0 + t]:
                keep[t] = before[t] != INPUTS - 1
                h = h * keep[t]
            old[t] = h
            *_, part, _, h = _step(weights, x[t].T, h.T)
            gn[t], new[t] = part.T, h.T
            h = h.T
        live = document[t0 : t0 + n, :lanes].ravel() >= 0
        tokens, whole = int(live.sum()), bool(live.all())
        grads = {k: np.zeros_like(v) for k, v in weights.items()}
        flat, codes = _by_unit(new), code[t0 : t0 + n, :lanes].ravel()
        logs, d_live = _output(weights, (flat if whole else flat[:, live]).T, codes if whole else codes[live], grads, 1 / max(1, tokens))
        d_states = d_live.T
        if not whole:
            d_states = np.zeros((HIDDEN, n * lanes), kind)
            d_states[:, live] = d_live.T
        d_states = d_states.reshape(HIDDEN, n, lanes)
        z, r, c = x[:, :HIDDEN], x[:, HIDDEN : 2 * HIDDEN], x[:, 2 * HIDDEN :]
        by_n, by_z, by_r = (1 - z) * (1 - c * c), (old - c) * z * (1 - z), gn * r * (1 - r)
        dg, dn = np.empty((n, 3 * HIDDEN, lanes), kind), np.empty((n, HIDDEN, lanes), kind)
        carried = np.zeros((HIDDEN, lanes), kind)
        for t in range(n - 1, -1, -1):
            carried += d_states[:, t]
            np.multiply(carried, by_n[t], out=dn[t])
            np.multiply(carried, by_z[t], out=dg[t, :HIDDEN])
            np.multiply(dn[t], by_r[t], out=dg[t, HIDDEN : 2 * HIDDEN])
            np.multiply(dn[t], r[t], out=dg[t, 2 * HIDDEN :])
            carried *= z[t]
            carried += state @ dg[t]
            if t in keep:
                carried *= keep[t]
        d_units = _by_unit(dg)
        grads["state"] += _by_unit(old) @ d_units.T
        d_units[2 * HIDDEN :] = _by_unit(dn)  # now the gradient of what the inputs add
        _add_by_code(grads["inputs"], before.ravel(), d_units)
        adam.apply(grads, min(1.0, tokens / (n * code.shape[1])))
        loss -= float(logs.sum())
        count += tokens
    return loss / max(1.0, count)


class _Reader:
    """Turns texts into ranks and codes by a broadcast vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words = pa.array(sorted(vocabulary.places, key=vocabulary.places.get), pa.binary())
        two = [bucket_of(bytes([a, b])) for a in range(256) for b in range(256)]
        self.buckets = np.array(two + [bucket_of(bytes([b])) for b in range(256)], dtype=np.int16)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """``ranks`` (-1: not broadcast), ``codes`` and ``lengths``, the words that aren't broadcast and their number by text."""
        words, counts = split_words(texts)
        found = pc.index_in(words, value_set=self.words)
        known = pc.is_valid(found).to_numpy(zero_copy_only=False)
        rank = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
        unknown = words.filter(pc.invert(pc.is_valid(found)))
        code = self.v.codes[rank] if len(self.v.codes) else np.zeros(len(rank), dtype=np.int16)
        last, before = last_bytes(unknown)
        code[~known] = HEAD + self.buckets[np.where(before < 0, 65536 + last, 256 * before + last)]
        lengths, of = counts + 1, np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(rank)) + of  # each text's end comes after its words
        end = self.v.places.get(END, -1)
        ranks = np.full(len(rank) + len(counts), end, dtype=np.int32)
        codes = np.full(len(ranks), self.v.codes[end] if end >= 0 else HEAD + bucket_of(END), dtype=np.int16)
        ranks[at], codes[at] = rank, code
        return ranks, codes, lengths, unknown, np.bincount(of[~known], minlength=len(counts))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word binary, c long)`` over all rows of ``docs (text binary)``, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_runs(batch.column(0), STEP):
                words, counts = split_words(texts)
                found = pc.value_counts(words)
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "c"])
                yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([len(counts)], pa.int64())], names=["word", "c"])

    return materialise(docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def vocabulary_of(counts: DataFrame, broadcast_words: int = 131_072) -> Vocabulary:
    """The most frequent words, ``broadcast_words`` at most (a fixed bound), go to every task; counts
    of all others stay in the table. The end of a text is always a head word.

    A histogram of counts tells from which count on the words stay within the bound, so only
    they are sent to the driver, however many tasks there are.
    """
    grade = F.floor(F.log2("c") * 16)
    least, within = None, 0
    for r in counts.where(F.col("word") != END).groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("g")).collect():
        within += r["n"]
        if within >= broadcast_words:
            break
        least = r["c"]
    frequent = F.col("word") == END if least is None else (F.col("word") == END) | (F.col("c") >= least)
    top = sorted(counts.where(frequent).collect(), key=lambda r: (bytes(r["word"]) != END, -r["c"], bytes(r["word"])))
    places = {bytes(r["word"]): i for i, r in enumerate(top)}
    head = counts.sparkSession.createDataFrame([(w,) for w, i in places.items() if i < HEAD], "word binary")
    tail = counts.join(F.broadcast(head), "word", "left_anti")
    bucket = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(BUCKETS)).cast("int")
    tokens, words = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in tail.groupBy(bucket.alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["b"]], words[r["b"]] = r["n"], r["v"]
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    return Vocabulary(places, np.array([r["c"] for r in top], dtype=np.float64), tokens, words, total["n"], total["v"])


def warm_texts(docs: DataFrame, most_rows: int, most_bytes: int) -> list[bytes]:
    """Whole texts of at most ``most_rows`` rows and ``most_bytes`` together, in order of a hash of their
    id. Ids and sizes choose them, so that no task sends other texts; a text that doesn't fit any more is passed over."""
    size = F.octet_length("text")
    first = docs.groupBy("id").agg(F.max(size).alias("size")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    ids, room = [], most_bytes
    for r in first.collect():
        if r["size"] <= room:
            ids.append((r["id"],))
            room -= r["size"]
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(ids, docs.select("id").schema)
    rows = docs.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text")).orderBy(F.xxhash64("id"), "id")
    return [bytes(r["text"]) for r in rows.collect()]


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Array]]:
    """``(shard, texts)`` rows in order of shard -> runs of one shard's texts that end where they reach ``size`` bytes,
    wherever the batches' borders lie."""
    held, used, current = [], 0, None
    for batch in batches:
        shards, i = batch.column(0).to_numpy(), 0
        lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        while i < len(shards):
            if held and shards[i] != current:
                yield current, pa.concat_arrays(held)
                held, used = [], 0
            current = shards[i]
            end = int(np.searchsorted(shards, current, side="right"))
            ends = used + np.cumsum(lengths[i:end])
            j = min(end, i + int(np.searchsorted(ends, size)) + 1)
            held.append(batch.column(1).slice(i, j - i))
            used = int(ends[j - i - 1])
            if used >= size:
                yield current, pa.concat_arrays(held)
                held, used = [], 0
            i = j
    if held:
        yield current, pa.concat_arrays(held)


def _summed(parts: DataFrame, count: int, fan_in: int = 64) -> DataFrame:
    """``(block, part, seen, body)`` of ``count`` parts added up by block, ``fan_in`` at a time and in order of parts."""

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        total = sum(np.frombuffer(b, dtype=np.float64) for b in rows.column("body").to_pylist())
        return pa.table({"block": rows.column("block")[:1], "part": rows.column("group")[:1], "seen": [sum(rows.column("seen").to_pylist())], "body": pa.array([total.tobytes()], pa.binary())})

    while count > 1:
        parts = parts.withColumn("group", F.floor(F.col("part") / fan_in)).groupBy("block", "group").applyInArrow(add, parts.schema)
        count = -(-count // fan_in)
    return parts


def train(docs: DataFrame, vocabulary: Vocabulary, warm_rows: int = 256, warm_bytes: int = 4 << 20, warm_rate: float = 0.01, rate: float = 0.004, shard_tokens: int = 4_000_000, rounds: int = 2, lanes: int = 128) -> dict[str, np.ndarray]:
    """Weights after one pass over all of ``docs (id, text binary)``.

    A warm start on a bounded sample gives all shards the same point to go on
    from. Rows are dealt over shards of about ``shard_tokens`` tokens by a hash of
    their id; shards over ``rounds`` rounds, one more for each doubling beyond 64 shards. A round's shards start from the
    weights that the one before averaged.
    """
    spark = docs.sparkSession
    weights = new_weights(vocabulary)
    warm = warm_texts(docs, warm_rows, warm_bytes)
    if warm:
        adam = Adam(weights, warm_rate)
        _, codes, lengths, *_ = _Reader(vocabulary).read(pa.array(warm, pa.binary()))
        for _ in range(2):
            train_lanes(adam, *lanes_of(codes, lengths, 32), window=16)
    shards = max(1, math.ceil(vocabulary.tokens / shard_tokens))
    rounds = min(max(rounds, shards.bit_length() - 4), shards)
    names, step, block = list(weights), STEP, 16_384
    shard = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards))
    order = F.xxhash64("id")
    rows = docs.select(shard.alias("shard"), order.alias("order"), F.xxhash64("text").alias("tie"), "id", "text")
    schema = "block long, part long, seen double, body binary"
    for turn in range(rounds if vocabulary.tokens else 0):
        shared = spark.sparkContext.broadcast((vocabulary, weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, start = shared.value
            reader, adam, current, seen = _Reader(vocabulary), None, None, 0

            def emit() -> Iterator[pa.RecordBatch]:
                flat = np.concatenate([adam.weights[k].ravel() for k in names]).astype(np.float64) * seen
                for b, at in enumerate(range(0, len(flat), block)):
                    yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([int(current) // rounds]), pa.array([float(seen)]), pa.array([flat[at : at + block].tobytes()], pa.binary())], names=["block", "part", "seen", "body"])

            for shard, texts in _gathered(batches, step):
                if shard != current:
                    if seen:
                        yield from emit()
                    current, seen, adam = shard, 0, Adam({k: v.copy(order="K") for k, v in start.items()}, rate)
                _, codes, lengths, *_ = reader.read(texts)
                train_lanes(adam, *lanes_of(codes, lengths, lanes))
                seen += int(lengths.sum())
            if seen:
                yield from emit()

        here = len(range(turn, shards, rounds))
        dealt = rows.where(F.col("shard") % rounds == turn).repartitionById(here, F.floor(F.col("shard") / rounds).cast("int")).sortWithinPartitions("shard", "order", "id", "tie")
        got = sorted(_summed(dealt.select("shard", "text").mapInArrow(run, schema), here).collect(), key=lambda r: r["block"])
        if got:
            flat, at, averaged = np.concatenate([np.frombuffer(bytes(r["body"]), dtype=np.float64) / r["seen"] for r in got]), 0, {}
            for k, v in weights.items():
                averaged[k] = np.asarray(flat[at : at + v.size].reshape(v.shape), np.float32, order="F" if k == "inputs" else "C")
                at += v.size
            weights = averaged
    return weights


def _score_rows(docs: DataFrame, vocabulary: Vocabulary, weights: dict[str, np.ndarray], lanes: int = 128) -> DataFrame:
    """Per row what needs no further count, and the words that do (``rest``)."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        reader, row = _Reader(vocabulary), TaskContext.get().partitionId() << 33
        logs, bucket_logs = np.append(vocabulary.logs, 0.0), vocabulary.bucket_logs()
        for batch in batches:
            i = 0
            for texts in text_runs(batch.column(1), STEP):
                ranks, codes, lengths, unknown, missing = reader.read(texts)
                n = len(texts)
                of = np.repeat(np.arange(n, dtype=np.int32), lengths)
                tail = codes >= HEAD
                in_head = np.bincount(of, weights=np.where(tail, 0.0, logs[ranks]), minlength=n)
                in_tail = np.bincount(of, weights=np.where(tail, logs[ranks], 0.0), minlength=n)
                shares = np.bincount(of[tail], weights=bucket_logs[codes[tail] - HEAD], minlength=n)
                known = np.bincount(of, weights=ranks >= 0, minlength=n).astype(np.int64)
                del of, tail, ranks
                model = score_lanes(weights, *lanes_of(codes, lengths, lanes), n) / math.log(10)
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(missing)]), pa.int32()), unknown)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column(0).slice(i, n), pa.array(lengths), pa.array(known), pa.array(in_head + in_tail), pa.array(model - shares + in_tail), rest],
                    names=["row", "id", "n_tokens", "known", "count_logs", "model", "rest"],
                )
                row += n
                i += n

    return docs.select("id", "text").mapInArrow(run, f"row long, id {kind}, n_tokens long, known long, count_logs double, model double, rest array<binary>")


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = 131_072, **training) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` per row: log10 probabilities of the
    whole text under the add-one unigram base and under the model.

    Rows for which ``learn`` (a predicate on ``id``) holds are trained on, all of
    them; every row is scored. Null and empty texts are the end token alone;
    repeated rows and null ids keep a row each. Without training rows N and V are
    0, every word is new and the model falls back to its even start. Words beyond
    the ``broadcast_words`` most frequent meet their counts in a join. Very long
    texts are read whole, their state carried from window to window. Columns
    other than the two named are ignored, whatever their names; an empty table
    gives no rows. Scores don't depend on how the rows are partitioned, but for rounding.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    known_rows = rows.where(learn)
    counts = word_counts(known_rows)
    vocabulary = vocabulary_of(counts, broadcast_words)
    weights = train(known_rows, vocabulary, **training)
    scored = materialise(_score_rows(rows, vocabulary, weights), "scored")
    rest = scored.where(F.size("rest") > 0).select("row", F.explode("rest").alias("word")).join(counts, "word")
    late = rest.groupBy("row").agg(F.count(F.lit(1)).alias("late_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("late_logs"))
    zero = F.lit(0.0)
    return scored.join(late, "row", "left").select(
        "id",
        "n_tokens",
        (F.col("known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("count_logs") + F.coalesce("late_logs", zero) - F.col("n_tokens") * math.log10(vocabulary.tokens + vocabulary.words + 1)).alias("base_score"),
        (F.col("model") + F.coalesce("late_logs", zero)).alias("score"),
    )
