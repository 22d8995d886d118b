"""The pipeline against a brute-force version that takes the two classifiers' models as given."""

from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from assayer.llm import quality, toxicity
from assayer.llm.labelled import fold
from assayer.llm.queries import tokenizer_path
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the test tables")
def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer

    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, fold(F.col("id"), 5) != 0)
    rows = [r.asDict() for r in docs.collect()]
    scores = quality.predict(model, [(r["text"] or "").encode() for r in rows])
    rows = [r for r, s in zip(rows, scores) if s >= 0.3]
    tox = toxicity.fit(spark.createDataFrame(rows, docs.schema), labels, fold(F.col("id"), 3) != 1)
    get = tox.word_scores().__getitem__

    def clean(text):
        words = toxicity.words_of((text or "").encode())
        segments = toxicity.maximal_segments(np.array([get(w) for w in words], dtype=float))
        return 1 / (1 + np.exp(-(tox.intercept + tox.slope * tox.strength(segments, len(words))))) < 0.7

    rows = [r for r in rows if clean(r["text"])]
    best = {}
    for r in rows:
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    rows = [r for r in rows if best[r["text"] or ""] == r["doc_id"]]
    rows.sort(key=lambda r: r["doc_id"])
    words = [(r["text"] or "").encode().lower().split() for r in rows]
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    rows = [r for i, r in enumerate(rows) if root(i) == i]
    t = Tokenizer.from_file(tokenizer_path())
    want = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows}
    lengths = defaultdict(int)
    for g in got:
        lengths[g.doc_id] += g.length
    assert want == dict(lengths)
    assert len(want) < docs.count()


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null and empty texts, a very long one, repeated rows and empty tables."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"w{i}" for i in range(150_000))
    odd = spark.createDataFrame([(90_000, None, "en", "s", 0), (90_001, "", "en", "s", 0), (90_002, long, "en", "s", len(long)), (90_003, long + " end", None, None, 1), (90_004, "x", "en", "s", 1), (90_004, "x", "en", "s", 1)], base.schema)
    for name, docs in (("odd", base.union(odd)), ("none", base.where("1 = 0"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").where("1 = 1" if name == "odd" else "1 = 0").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        kept = {r.doc_id for r in rows}
        if name == "none":
            assert not rows
        else:
            assert len(kept & {90_000, 90_001}) <= 1 and len(kept & {90_002, 90_003}) <= 1 and len(kept) > 50
            assert sum(r.doc_id == 90_004 for r in rows) <= 1
