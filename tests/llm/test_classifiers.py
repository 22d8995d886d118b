"""Toxic segments against a plain scan, gradients against differences, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from assayer.llm import quality, toxicity
from assayer.llm.labelled import fold
from pyspark.sql import functions as F


def brute_maximal(scores):
    """Maximal segments by repeatedly taking the best one and searching both sides of it."""
    out = []

    def search(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sum(scores[i:j])
                if best is None or s > best[2]:
                    best = (i, j, s)
        if best and best[2] > 0:
            search(a, best[0])
            out.append(best)
            search(best[1], b)

    search(0, len(scores))
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_maximal_segments(seed):
    rnd = random.Random(seed)
    scores = [rnd.choice([-3, -1, -2, 2, 5, 1]) + rnd.random() / 100 for _ in range(25)]
    got = [(a, b, s) for a, b, s in toxicity.maximal_segments(np.array(scores))]
    want = brute_maximal(scores)
    assert [x[:2] for x in sorted(got)] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in sorted(got)], [x[2] for x in want])


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "tu", "ren"]) for _ in range(rnd.randrange(1, 4)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rnd.randrange(20, 200))]
        bad, junk = i % 5 == 0, i % 4 == 1
        if bad:
            at = rnd.randrange(len(words) - 5)
            words[at : at + 5] = [rnd.choice(["Vile!", "nasty,", "gross"]) for _ in range(5)]
        rows.append((i, ("### ".join(words) + "###") if junk else " ".join(words), None, 1))
        labels.append((i, 0 if junk else 1, int(bad), "x"))
    rows += [(2000, None, "en", 2), (2001, "", "en", 2), (2002, " ".join(["ka"] * 200_000), "en", 1), (None, "vile nasty gross vile nasty", "en", 1), (3, rows[3][1], None, 1)]
    labels += [(5000, 1, 1, "no text"), (6, None, None, "null"), (None, 1, 1, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, label int").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_toxicity_held_out(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, fold(F.col("id"), 3) != 1, per_class=400)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    scores = {r.id: r for r in rows}
    for i in range(900):
        assert (scores[i].score >= 0.7) == (i % 5 == 0)
        assert bool(scores[i].passages) == (i % 5 == 0)
    assert scores[None].score >= 0.7 and scores[2000].score == scores[2001].score < 0.7
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if r.doc_id is not None and not (r.doc_id < 900 and r.doc_id % 5 == 0)}


def test_quality_held_out(spark, corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels, fold(F.col("id"), 5) != 0, per_class=400, epochs=8)
    scores = {r.id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.3) == (i % 4 != 1) for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in scores.values()) and {2000, 2001, 2002, None} <= scores.keys()
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 660 < kept.count() < 700  # of 675 good rows and five more


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_no_labels_and_no_rows(spark, corpus, kind):
    docs, labels = corpus
    model = kind.fit(docs, labels.where("1=0"), F.lit(True))
    assert {round(r.score) for r in kind.score(docs, model).collect()} == {1 if kind is quality else 0}
    model = kind.fit(docs.where("1=0"), labels, F.lit(True))
    assert kind.score(docs.where("1=0"), model).count() == 0


def test_training_reads_no_held_out_label(spark, corpus):
    docs, labels = corpus
    learn = fold(F.col("id"), 3) != 1
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels, learn, per_class=100) == toxicity.fit(docs, flipped, learn, per_class=100)


def test_features_cover_the_whole_text_alike_in_any_batch():
    rng = np.random.default_rng(0)
    model = quality.QualityModel(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(size=quality.FILTERS), 0.1)
    model.table[:, 0] = 0
    texts = [b"", b"a", b"x" * 5000 + b"tail", None, bytes(rng.integers(1, 255, 40_000).tolist()), b"abc " * 64]
    alone = np.concatenate([quality.predict(model, [t]) for t in texts])
    assert np.allclose(alone, quality.predict(model, texts), atol=1e-5)
    changed = quality.features(model, [texts[4][:-5] + b"\x01\x02\x03\x04\x05"])
    assert not np.allclose(changed, quality.features(model, [texts[4]]))


def test_gradients():
    rng = np.random.default_rng(1)
    small = rng.normal(size=quality.FILTERS) * 0.05  # so that no probability saturates
    model = quality.QualityModel(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)), rng.normal(size=quality.FILTERS), small, 0.2)
    model.table[:, 0] = 0
    texts, y, w = [bytes(rng.integers(97, 101, n).tolist()) for n in (300, 50, 700)], np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss(m):
        p = quality.predict(m, texts)
        return -np.mean(w * (y * np.log(p) + (1 - y) * np.log(1 - p)))

    grads = quality._gradients(model, texts, y, w)
    for _ in range(12):
        k, b, f = rng.integers(quality.WIDTH), rng.integers(97, 101), rng.integers(quality.FILTERS)
        diffs = []
        for d in (1e-3, -1e-3):
            table = model.table.copy()
            table[k, b, f] += d
            diffs.append(loss(quality.QualityModel(table, model.bias, model.weights, model.intercept)))
        assert abs((diffs[0] - diffs[1]) / 2e-3 - grads["table"][k, b, f]) < 2e-3


def test_quality_equals_a_plain_convolution():
    import math

    import numpy as np
    from assayer.llm import quality as q

    rnd = np.random.default_rng(2)
    table = rnd.normal(0, 1, (q.WIDTH, 256, q.FILTERS)).astype(np.float32)
    table[:, 0] = 0
    model = q.QualityModel(table, rnd.normal(0, 1, q.FILTERS).astype(np.float32), rnd.normal(0, 1, q.FILTERS), 0.3)
    texts = [None, b"", b"a", bytes(rnd.integers(1, 256, 127, dtype=np.uint8)), bytes(rnd.integers(1, 256, 128, dtype=np.uint8)), bytes(rnd.integers(1, 256, 257, dtype=np.uint8)), bytes(rnd.integers(1, 256, 1500, dtype=np.uint8))]

    def plain(text):
        halves = max(2, math.ceil(len(text) / q.HALF))
        body = text.ljust(halves * q.HALF, b"\0")
        act = lambda p: sum(table[k, body[p + k]].astype(np.float64) for k in range(q.WIDTH) if p + k < len(body))
        tops = [np.maximum(np.max([act(p) for p in range(h * q.HALF, (h + 1) * q.HALF, q.STRIDE)], axis=0) + model.bias, 0) for h in range(halves)]
        pooled = np.mean([np.maximum(a, b) for a, b in zip(tops, tops[1:])], axis=0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(pooled @ model.weights) + model.intercept))))

    want = [plain(t or b"") for t in texts]
    assert np.abs(q.predict(model, texts) - want).max() < 1e-4
    assert np.abs(q.predict(model, texts, step=1) - want).max() < 1e-4


def test_toxicity_score_from_its_definition(spark):
    import math
    import random

    from assayer.llm import toxicity as t

    rnd = random.Random(6)
    odds = {b"bad": 2.0, b"^wor": 1.2, b"awful": 3.1, b"^ugl": 0.4}
    model = t.ToxicityModel(odds, -0.35, 0.8, 0.1, -2.0, 0.5)
    texts = [None, "", "bad"] + [" ".join(rnd.choices(["bad", "fine", "worse", "awful", "ugly", "ok", "Word", "day"], [1, 9, 1, 1, 1, 9, 1, 9], k=rnd.randrange(1, 120))) for _ in range(60)]

    def plain(text):
        words = (text or "").lower().split()
        scores = []
        for w in words:
            forms = [w.encode(), *(b"^" + w[:k].encode() for k in (7, 6, 5, 4, 3) if len(w) > k)]
            scores.append(next((odds[f] for f in forms if f in odds), -0.35))
        segments, todo = [], [(0, len(scores))]
        while todo:  # the best span, then both sides of it
            a, b = todo.pop()
            spans = [(sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            best = max(((round(s, 9), n, -i, i, j) for s, n, i, j in spans), default=(0,))
            if best[0] > 0:
                segments.append(sum(scores[best[3] : best[4]]))
                todo += [(a, best[3]), (best[4], b)]
        norm = sorted((0.8 * s - math.log(0.1 * max(1, len(words))) for s in segments), reverse=True)
        found, total = -3.0, 0.0
        for r, s in enumerate(norm, 1):
            if r > 1 and s <= 0:
                break
            total += s
            found = max(found, total if r == 1 else total - (r - 1) * math.log(max(1.0, total)) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)))
        return 1 / (1 + math.exp(-(-2.0 + 0.5 * min(found, 30.0))))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.score for r in t.score(docs, model).collect()}
    assert max(abs(got[i] - plain(x)) for i, x in enumerate(texts)) < 1e-9
