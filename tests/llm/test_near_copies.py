"""The pipeline's near stage against the Jaccard similarity of all pairs."""

import random

import corpus_pipeline
from assayer.llm import simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_stage_equals_brute_force(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n", "one two", "One  two", "one two three", "a b c d e", "a b c d e f"]
    for n in (12, 40, 100, 300, 900):
        for _ in range(6):
            base = [f"w{rnd.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for share in (0.01, 0.02, 0.03, 0.1):
                texts.append(" ".join(f"v{rnd.randrange(5000)}" if rnd.random() < share else w for w in base))
    common = [f"c{i}" for i in range(200)]
    texts += [" ".join(common + [f"t{k}x{i}" for i in range(k)]) for k in range(5, 90, 5)]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    sets = [shingles(t) for _, t in rows]
    up, far = list(range(len(rows))), 0

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                far += (fps[i] ^ fps[j]).bit_count() > 4
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert far > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(rows)) if root(i) == i]
    assert corpus_pipeline.near_stage(spark, docs.where("false"), "").count() == 0


def test_parity_bound_loses_no_pair():
    import numpy as np
    from assayer.llm import near_copies

    rnd = np.random.default_rng(8)
    sets, base = [], {}
    for i in range(160):
        size = int(rnd.choice([1, 2, 30, 250, 256, 300, 600, 5000]))
        if i % 2 or size not in base:
            base[size] = rnd.integers(0, 1 << 63, size, dtype=np.uint64)
        s = base[size].copy()
        for k in rnd.choice(size, int(size * rnd.choice([0, 0.02, 0.1, 0.12, 0.3])), replace=False):
            s[k] = rnd.integers(0, 1 << 63, dtype=np.uint64)
        sets.append(np.unique(s[: max(1, int(size * rnd.choice([1, 0.9, 0.8])))]))
    rows = {"n": np.array([len(s) for s in sets]), "comp": np.arange(len(sets)) % 150, "par": [near_copies.parities(s) for s in sets]}
    got = set(zip(*(x.tolist() for x in near_copies.close_pairs(rows, rows, 0.8, room=1 << 12))))
    near = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            common = len(np.intersect1d(x, y))
            if common >= 0.8 * (len(x) + len(y) - common) and rows["comp"][i] != rows["comp"][j]:
                near += 1
                assert (i, j) in got
    assert near > 50 and len(got) < 3 * near


def test_operator_1_links_first_and_texts_decide(spark, monkeypatch):
    """Without any band in common near copies still meet by their fingerprints; what isn't similar enough is left apart."""
    from assayer.llm import near_copies

    rnd = random.Random(9)
    texts = []
    for _ in range(6):
        base = [f"w{rnd.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(base), " ".join([*base[:200], "changed", *base[201:]]), " ".join(base[:4])]
    fps = [simhash.fingerprint(t.encode()) for t in texts]
    near = [k for k in range(0, len(texts), 3) if (fps[k] ^ fps[k + 1]).bit_count() <= 4]
    assert near
    sketch, seen = near_copies.sketched, []
    alone = lambda *args: sketch(*args).withColumn("bands", near_copies.F.array(near_copies.F.col("key")))
    monkeypatch.setattr(near_copies, "sketched", alone)
    monkeypatch.setattr(simhash, "link", lambda *args, real=simhash.link: seen.append(1) or real(*args))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert seen and kept == set(range(len(texts))) - {k + 1 for k in near}


def test_rounds_send_no_table_through_the_driver(spark, monkeypatch):
    """A broadcast is made in the driver, which holds megabytes for each until garbage is collected."""
    from assayer.llm import graph, near_copies, workspace

    rnd, plans = random.Random(10), []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return workspace.materialise(df, name)

    for module in (graph, near_copies, simhash):
        monkeypatch.setattr(module, "materialise", kept)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    texts = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 300, 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()] == [0]
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]


def test_differing_bytes_of_sketches(spark):
    from assayer.llm import near_copies

    rnd = random.Random(11)
    word = lambda: int.from_bytes(bytes(rnd.choice([0, 0, 1, 127, 128, 255, rnd.randrange(256)]) for _ in range(8)), "little", signed=True)
    rows = [([word() for _ in range(20)], [word() for _ in range(20)]) for _ in range(200)]
    as_bytes = lambda x: b"".join(v.to_bytes(8, "little", signed=True) for v in x)
    want = [sum(p != q for p, q in zip(as_bytes(a), as_bytes(b))) for a, b in rows]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(near_copies._differ(near_copies.F.col("a"), near_copies.F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == want
