"""Nearest neighbours against brute force: recall, exact scores, ties and rows left out."""

import numpy as np
from assayer.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[500:700] = x[20]
    rows = [(i, v.tolist(), 1, None) for i, v in enumerate(x)]
    rows += [(4000, None, 1, "a"), (4020, [0.0] * 32, 1, "z"), (4040, [1.0] * 31 + [None], 1, "n"), (4060, [float("nan")] * 32, 1, "f"), (4080, [float("inf")] + [1.0] * 31, 1, "i"), (4100, [1.0] * 7, 1, "short"), (4120, [], 1, "e"), (None, [9.0] * 32, 1, "no id"), (60, x[60].tolist(), 2, "repeated")]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), rerank=300, block_rows=1000, query_rows=64, sample_rows=2000, books=8, entries=64).collect()
    xd = x.astype(np.float64)
    hits, by_query = 0, {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(by_query) == list(range(0, 3000, 20))
    twice = by_query.pop(60)  # both rows of the id ask, and each is the other's nearest
    assert sorted(f[0] for f in twice) == sorted([*range(1, 21)] * 2)
    assert [f[1] for f in sorted(twice)[:2]] == [60, 60] and 60 not in [f[1] for f in sorted(twice)[2:]]
    for q, found in by_query.items():
        found.sort()
        scores = xd @ xd[q]
        order = [i for i in np.lexsort((np.arange(3000), -scores)) if i != q][:20]
        assert [f[0] for f in found] == list(range(1, 21))
        assert q not in [f[1] for f in found]
        assert all(abs(f[2] - scores[f[1]]) < 1e-9 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(order))
    assert hits / (20 * len(by_query)) >= 0.9
    copies = [f[1] for f in sorted(by_query[600])]
    assert copies == [20, *range(500, 519)]


def test_recall_as_shipped(spark):
    """The parameters of the query: of 6,000 vectors under 4 % are scored exactly."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)).collect()
    scores = x[::20] @ x.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -9
    true = [set(r) for r in np.argsort(-scores, axis=1)[:, :20].tolist()]
    assert len(got) == 6000 and sum(r.vec_id in true[r.query_id // 20] for r in got) / 6000 >= 0.9


def test_lengths_do_not_meet_and_repeated_rows_count(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 5.0, 5.0]), (20, [1.0, 1.0, 1.0]), (3, [-0.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())
    assert found == sorted([(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 0, 0.0), (0, 1, 0, 0.0), (0, 2, 1, 0.0), (0, 3, 1, 0.0), (20, 1, 2, 15.0)])


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1, ""), (3, [0.5, 0.5], 1, ""), (4, [0.5, 0.5], 1, "")]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 3, 0.5), (0, 2, 4, 0.5)]
    assert ann.nearest(spark.createDataFrame(rows[:1], SCHEMA)).count() == 0
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.nearest(spark.createDataFrame([(5, None, 1, "")], SCHEMA)).count() == 0


def test_coarse_codes_get_longer_lists(spark):
    """Codes that tell little: a fixed list of 40 misses most of the nearest; ties go by id, in whatever order rows lie."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(1500, 48)), 30 + rng.normal(size=(20, 48)) * 0.1, np.sign(rng.normal(size=(1480, 48)))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)][::-1]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), rerank=40, block_rows=1000, sample_rows=500, books=2, entries=16).collect()
    scores, hits = x[::20] @ x.T, 0
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for row, q in enumerate(range(0, 3000, 20)):
        true = [i for i in np.lexsort((np.arange(3000), -np.round(scores[row], 9))) if i != q][:20]
        hits += len(found[q] & set(true))
    assert len(got) == 3000 and hits / 3000 >= 0.95


def test_lists_hold_no_more_than_their_entries():
    """A query keeps its list alone, not the scores of a whole block that it was cut from; equal scores go to the first entries."""
    import tracemalloc

    rng = np.random.default_rng(6)
    model = ann.train(rng.normal(size=(400, 8)), books=4, entries=16)
    codes, norm = rng.integers(0, 16, (40_000, 4)).astype(np.uint8), np.ones(40_000)
    codes[30_000:] = codes[:10_000]
    queries = rng.normal(size=(640, 8))
    tracemalloc.start()
    got = ann.approximate(model, queries, codes, norm, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # blocks of 32 queries whose scores stayed took 40,000 * 640 * 8 bytes
    tables, scores = model.tables(queries), np.zeros((640, 40_000), dtype=np.float32)
    for table, code in zip(tables, codes.T):
        scores += table[:, code]
    scores += np.linalg.norm(queries, axis=1).astype(np.float32)[:, None] * np.float32(1e-6)
    want = [np.lexsort((np.arange(40_000), -s))[:100] for s in scores]
    assert got[0].tolist() == np.repeat(np.arange(640), 100).tolist()
    assert got[1].tolist() == np.concatenate(want).tolist()
