"""The language model: counts and base scores against brute force, normalised output, gradients, held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from assayer.llm import lm
from assayer.llm.labelled import fold
from pyspark.sql import functions as F


def corpus():
    rnd = random.Random(9)
    tongues = [["the", "of", "and", "stone", "river", "walk"], ["der", "und", "von", "haus", "berg", "gehen"], ["le", "de", "et", "maison", "ville", "dans"]]
    rows = []
    for i in range(300):
        words = [rnd.choice(tongues[i % 3]) + (str(rnd.randrange(9)) if rnd.random() < 0.1 else "") for _ in range(rnd.randrange(1, 120))]
        rows.append((i, " ".join(words).title(), None, "x"))
    return rows + [(900, None, "n", "x"), (901, "", "n", "x"), (902, " ".join(["the", "of"] * 5000), "n", "x"), (None, "the river", "n", "x"), (4, rows[4][1], "n", "x"), (903, "unseenword ÉÈ\x85 x", "n", "x")]


SCHEMA = "doc_id long, text string, score string, word string"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("broadcast_words", [131_072, 12])
def test_scores(spark, broadcast_words):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = lm.score_documents(docs, fold(F.col("id"), 7) != 2, broadcast_words=broadcast_words, warm_rows=64).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for i, t, *_ in rows:
        if i is not None and not held(i):
            counts.update(lm.words_of((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        words = lm.words_of((texts[r.id] or "").encode())
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    out = [r for r in got if held(r.id)]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_empty(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    assert lm.score_documents(docs.where("1=0"), F.lit(True)).count() == 0
    untrained = lm.score_documents(docs, F.lit(False)).collect()
    assert {r.train_tokens for r in untrained} == {0} and all(r.base_score == 0 and math.isfinite(r.score) for r in untrained)


def test_probabilities_sum_to_one(spark):
    counts = Counter({f"w{i}".encode(): 1 + 5000 // (i + 1) for i in range(1500)} | {lm.END: 40})
    table = spark.createDataFrame(list(counts.items()), "word binary, c long")
    vocabulary = lm.vocabulary_of(table, 1200)
    assert vocabulary.places[lm.END] == 0 and vocabulary.tokens == sum(counts.values()) and vocabulary.words == 1501
    head = {w for w, i in vocabulary.places.items() if i < lm.HEAD}
    for b in range(lm.BUCKETS):
        tail = [w for w in counts if w not in head and lm.bucket_of(w) == b]
        assert (vocabulary.bucket_tokens[b], vocabulary.bucket_words[b]) == (sum(counts[w] for w in tail), len(tail))
    rng = np.random.default_rng(0)
    weights = {k: (w + rng.normal(0, 0.2, w.shape)).astype(np.float32) for k, w in lm.new_weights(vocabulary).items()}
    h = np.repeat(rng.normal(size=(1, lm.HIDDEN)).astype(np.float32), lm.HEAD + lm.BUCKETS, axis=0)
    logs, _ = lm._output(weights, h, np.arange(lm.HEAD + lm.BUCKETS), None)
    assert np.exp(logs.astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)


def _small(seed=3):
    rng = np.random.default_rng(seed)
    lengths = np.array([5, 1, 9, 3, 30])
    codes = np.concatenate([rng.integers(0, lm.HEAD + lm.BUCKETS, n) for n in lengths])
    vocabulary = lm.Vocabulary({b"%d" % i: i for i in range(2000)}, rng.integers(1, 99, 2000).astype(float), np.ones(lm.BUCKETS), np.ones(lm.BUCKETS), 1, 1)
    weights = {k: (w + rng.normal(0, 0.3, w.shape)).astype(np.float64) for k, w in lm.new_weights(vocabulary).items()}
    return weights, codes, lengths


def test_score_is_alike_in_any_layout():
    weights, codes, lengths = _small()
    want = []
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for i in range(len(lengths)):
        h, before, total = np.zeros((1, lm.HIDDEN)), lm.INPUTS - 1, 0.0
        for c in codes[starts[i] : starts[i + 1]]:
            *_, h = lm._step(weights, weights["inputs"][[before]], h)
            total += lm._output(weights, h, np.array([c]), None)[0][0]
            before = c
        want.append(total)
    for lanes, window in ((1, 3), (2, 4), (9, 32)):
        assert np.allclose(lm.score_lanes(weights, *lm.lanes_of(codes, lengths, lanes), len(lengths), window), want, rtol=1e-3)


def test_gradients():
    weights, codes, lengths = _small()
    layout = lm.lanes_of(codes, lengths, 3)
    seen = {}

    class Catch(lm.Adam):
        def apply(self, grads, share=1.0):
            seen.update({k: g.copy() for k, g in grads.items()})

    lm.train_lanes(Catch(weights, 0.0), *layout, window=64)
    loss = lambda w: -lm.score_lanes(w, *layout, len(lengths), 64).sum() / len(codes)
    for k, w in weights.items():
        for at in np.argsort(-np.abs(seen[k]).ravel())[: 4 if k != "words" else 3]:
            index = np.unravel_index(at, w.shape)
            values = []
            for d in (1e-2, -1e-2):
                changed = {**weights, k: w.copy()}
                changed[k][index] += d
                values.append(loss(changed))
            assert (values[0] - values[1]) / 2e-2 == pytest.approx(seen[k][index], rel=0.05, abs=2e-4), k


def test_partitions_do_not_change_scores(spark):
    docs = spark.createDataFrame(corpus()[:302], SCHEMA)
    learn = fold(F.col("id"), 7) != 2
    found = []
    for n in (1, 9):
        rows = lm.score_documents(docs.repartition(n), learn, shard_tokens=3000, warm_rows=32).collect()
        found.append({r.id: (r.score, r.base_score) for r in rows})
    assert found[0].keys() == found[1].keys()
    for i, (score, base) in found[0].items():
        assert found[1][i] == pytest.approx((score, base), rel=1e-4)


def test_scores_equal_a_plain_recomputation(spark):
    """The whole operator against one state, one word and one softmax at a time, in double precision."""
    rows = corpus()[:60] + corpus()[-1:]
    docs = spark.createDataFrame(rows, SCHEMA)
    learn = fold(F.col("id"), 7) != 2
    options = {"shard_tokens": 1000, "warm_rows": 16}
    got = {r.id: r.score for r in lm.score_documents(docs, learn, broadcast_words=40, **options).collect()}
    known = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).where(learn)
    counts = {bytes(r.word): r.c for r in lm.word_counts(known).collect()}
    vocabulary = lm.vocabulary_of(lm.word_counts(known), 40)
    weights = {k: w.astype(np.float64) for k, w in lm.train(known, vocabulary, **options).items()}
    head = sorted(vocabulary.places, key=vocabulary.places.get)[: lm.HEAD]
    place = {w: i for i, w in enumerate(head)}
    tail_tokens, tail_words = Counter(), Counter()
    for w, c in counts.items():
        if w not in place:
            tail_tokens[lm.bucket_of(w)] += c
            tail_words[lm.bucket_of(w)] += 1
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    softmax = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    for i, text, *_ in rows:
        h, before, total = np.zeros(lm.HIDDEN), lm.INPUTS - 1, 0.0
        for w in lm.words_of((text or "").encode()):
            x, g = weights["inputs"][before], h @ weights["state"]
            z, r = (sigmoid(x[k : k + lm.HIDDEN] + g[k : k + lm.HIDDEN]) for k in (0, lm.HIDDEN))
            n = np.tanh(x[2 * lm.HIDDEN :] + r * g[2 * lm.HIDDEN :])
            h = n + z * (h - n)
            outer = softmax(h @ weights["classes"] + weights["class_bias"])
            if w in place:
                c, k = divmod(place[w], lm.PER_CLASS)
                total += math.log10(outer[c] * softmax(h @ weights["words"][c] + weights["word_bias"][c])[k])
                before = place[w]
            else:
                b = lm.bucket_of(w)
                total += math.log10(outer[lm.CLASSES + b] * (counts.get(w, 0) + 1) / (tail_tokens[b] + tail_words[b] + 1))
                before = lm.HEAD + b
        assert got[i] == pytest.approx(total, rel=1e-3), i


def test_warm_texts_are_whole_and_bounded(spark):
    rows = [(i, b"x" * (10 * i)) for i in range(40)] + [(99, b"y" * 10_000), (3, b"z")]
    docs = spark.createDataFrame(rows, "id long, text binary").repartition(4)
    found = lm.warm_texts(docs, 30, 1500)
    assert 0 < len(found) <= 30 and sum(map(len, found)) <= 1500 and b"y" * 10_000 not in found
    assert found == lm.warm_texts(docs.repartition(1), 30, 1500)


def test_sums_by_code_are_exact():
    """Many small terms behind a large one: single-precision running sums would lose them."""
    from assayer.llm import lm

    table = np.zeros((lm.INPUTS, 3), np.float32, order="F")
    codes = np.array([7] + [7] * 20_000 + [lm.INPUTS - 1], np.int16)
    units = np.array([[1.0] + [2.0**-25] * 20_000 + [k] for k in range(3)], np.float32)
    lm._add_by_code(table, codes, units)
    assert np.array_equal(table[7], np.full(3, np.float32(1 + 20_000 * 2.0**-25))) and table[-1].tolist() == [0, 1, 2]
    assert not table[:7].any() and not table[8:-1].any()
