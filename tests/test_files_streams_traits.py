"""Files, streams and the trait model."""

import io
import json
import zipfile

from assayer.operators import traits
from assayer.sources import files
from assayer.streaming import events
from pyspark.sql import functions as F


def docx(paragraphs, rows=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}{table}</w:body></w:document>")
    return out.getvalue()


def test_uploads(spark, tmp_path):
    (tmp_path / "1_a.docx").write_bytes(docx(["Jane", "", "Engineer"], [("x", "y"), ("", "z")]))
    (tmp_path / "2_b.docx").write_bytes(b"not a zip")
    (tmp_path / "3_c.txt").write_bytes(b"plain")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_uploads(spark, str(tmp_path)).collect()}
    assert got["1_a.docx"].text == "Jane\nEngineer\nx | y\nz" and len(got["1_a.docx"].sha) == 32
    assert got["2_b.docx"].text is None and "BadZipFile" in got["2_b.docx"].error
    assert "unsupported" in got["3_c.txt"].error
    kinds = spark.createDataFrame([("a.PDF", "application/pdf"), ("a.pdf", "text/plain"), ("a.exe", "application/pdf"), (None, None)], "filename string, mime_type string")
    ok, refused = files.split_uploads(kinds)
    assert [r.filename for r in ok.collect()] == ["a.PDF"] and refused.count() == 3


def test_reports(spark, tmp_path):
    report = {"analysis_id": 1, "overall_score": 77, "summary": "s", "requirements": [{"requirement": "a", "status": "Matched"}], "unknown": 1}
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "analysis_1.json").write_text(json.dumps(report, indent=2))
    (folder / "analysis_2.json").write_text("{broken")
    rows = files.read_reports(spark, str(folder))
    assert [(r.analysis_id, r.overall_score) for r in rows.collect()] == [(1, 77)]
    bodies = spark.createDataFrame([(json.dumps(report),), ("{broken",), ('{"analysis_id": 3}',), (None,)], "body string")
    assert [r.state for r in files.parse_reports(bodies).collect()] == ["ok", "malformed", "malformed", "missing"]
    out = str(tmp_path / "out")
    files.write_reports(rows, out)
    files.write_reports(rows.withColumn("overall_score", F.lit(5)), out)
    assert [r.overall_score for r in spark.read.json(out).collect()] == [5]
    made = files.export_json(rows).first()
    assert json.loads(made.body)["overall_score"] == 77 and len(made.etag) == 32
    text = spark.createDataFrame([("```json\n{\"a\": {\"b\": 1}}\n```",), ("none",)], "t string")
    assert [r.j for r in text.select(files.json_in_text(F.col("t")).alias("j")).collect()] == ['{"a": {"b": 1}}', None]


def test_index_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, [0.1]), (2, 0, [0.2])], "resume_id long, chunk_id int, embedding array<float>")
    files.write_index(rows, str(tmp_path / "i"))
    files.write_index(rows.where("resume_id = 1").withColumn("chunk_id", F.lit(9)), str(tmp_path / "i"))
    assert {(r.resume_id, r.chunk_id) for r in files.read_index(spark, str(tmp_path / "i")).collect()} == {(1, 9), (2, 0)}
    assert files.read_index(spark, str(tmp_path / "i"), 2).count() == 1
    files.write_ranking_csv(spark.createDataFrame([(1, 'a "q", b', None, ["x", "y"])], "rank int, name string, score int, missing array<string>"), str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "c")).first()
    assert back.rank == "1" and back.missing == "x; y" and back.score is None


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "events"), str(tmp_path / "days")
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 10:00' + make_dt_interval(0, id * 6) AS ts, 'click' AS event_type FROM range(40)")
    rows.write.parquet(source)
    events.daily_counts_of_folder(spark, source, rows.schema, str(tmp_path / "cp"), target).awaitTermination()
    got = {r.day: r["count"] for r in spark.read.parquet(target).collect()}
    assert got and all(got[d] == n for d, n in {"2024-01-01": 3, "2024-01-02": 4}.items())
    seen = []
    events.apply_each(events.read_drop(spark, source, rows.schema), lambda df, i: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination()
    assert sum(seen) == 40


def test_traits(spark, tmp_path):
    rows = [(f"{'team people lead' if i % 2 else 'code math alone'} word{i}", *([0.9 if i % 2 else 0.1] * 5)) for i in range(40)]
    names = ", ".join(f"{t} double" for t in traits.TRAITS)
    data = spark.createDataFrame(rows, f"Resume_Text string, {names}")
    data.coalesce(1).write.option("header", True).csv(str(tmp_path / "t"))
    data = files.read_traits_csv(spark, str(tmp_path / "t"))
    train, test = traits.split(data, "Resume_Text")
    assert train.count() + test.count() == 40 and test.count() > 0
    got = traits.train(train).transform(test).collect()
    assert all((r.openness_score > 7.5) == (r.Openness > 0.5) and 0 <= r.openness_score <= 10 for r in got)
    clean = spark.createDataFrame([("A  B1, c!",)], "t string").select(traits.normalise_text(F.col("t")).alias("x")).first().x
    assert clean == "a b c"


def test_trait_model_equals_a_plain_ridge(spark):
    """200 documents, every term, smooth idf, unit rows, intercepts apart: numpy on the whole matrix."""
    import math
    import re
    from collections import Counter

    import numpy as np
    from pyspark.ml.feature import StopWordsRemover

    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(198).collect()] + ["", "the and of"]
    rnd = np.random.default_rng(5)
    y = rnd.random((200, 5))
    rows = spark.createDataFrame([(i, t if t else None, *map(float, v)) for i, (t, v) in enumerate(zip(docs, y))], "i int, Resume_Text string, " + ", ".join(f"{t} double" for t in traits.TRAITS)).repartition(7)
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    bags = [Counter(w for w in re.findall(r"\b\w\w+\b", t.lower()) if w not in stop) for t in docs]
    names = sorted({w for b in bags for w in b})
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log(201 / (1 + df[w])) + 1 for w in names}
    place = {w: k for k, w in enumerate(names)}
    x = np.zeros((200, len(names)))
    for i, b in enumerate(bags):
        for w, n in b.items():
            x[i, place[w]] = n * idf[w]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    xc, yc = x - x.mean(axis=0), y - y.mean(axis=0)
    w = xc.T @ np.linalg.solve(xc @ xc.T + 200 * 0.01 * np.eye(200), yc)
    model = traits.train(rows)
    got = {r.term: (r.idf, r.weights) for r in model.coefficients.collect()}
    assert set(got) == set(names) and max(abs(got[v][0] - idf[v]) for v in names) < 1e-12
    assert np.abs(np.array([got[v][1] for v in names]) - w).max() < 1e-6
    assert np.abs(np.array(list(model.intercepts.values())) - (y.mean(axis=0) - x.mean(axis=0) @ w)).max() < 1e-6
    scores = {r.i: r.openness_score for r in model.transform(rows).collect()}
    plain = np.clip((x @ w + y.mean(axis=0) - x.mean(axis=0) @ w + 1) * 5, 0, 10)[:, 2]
    assert max(abs(scores[i] - plain[i]) for i in range(200)) < 0.0051 and len(scores) == 200


def test_each_sum_reaches_the_driver_once(spark):
    """However many tasks add to a piece, it is merged in one, and terms of a single row have no place in the fit."""
    import numpy as np
    from assayer.operators import passes

    seen, rows = [], spark.range(0, 64, 1, 16)
    collect = type(rows).collect
    type(rows).collect = lambda self: seen.append(collect(self)) or seen[-1]
    try:
        got = passes.total(rows, lambda batch, out: np.add(out, batch.num_rows, out=out), (3 * passes.PIECE,))
    finally:
        type(rows).collect = collect
    assert (got == 64).all() and sorted(r["piece"] for r in seen[-1]) == [0, 1, 2]
    counts = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "b", 3)], "__row long, term string, tf long")
    assert {r.term: r.place for r in traits.vocabulary(counts, 2).collect()} == {"a": 0, "b": None}


def test_trait_passes_add_up_blocks_that_number_their_own_terms(spark):
    """Sums over blocks equal those over rows, whatever is zero in them; stop words are asked for as a set and words are runs of word characters."""
    import numpy as np
    import pyarrow as pa
    from assayer.operators import passes, traits

    rnd, size, m = np.random.default_rng(2), 60_000, 2
    lists = [np.sort(rnd.choice(size, rnd.integers(0, 9), replace=False)) for _ in range(300)]
    weights, y, share = [rnd.normal(size=len(x)) for x in lists], rnd.normal(size=(300, m)), rnd.random(300)
    batch = pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in lists], pa.list_(pa.int64())), pa.array([x.tolist() for x in weights], pa.list_(pa.float64())), pa.array(y.tolist(), pa.list_(pa.float64())), pa.array(share)], names=["places", "weights", "y", "share"])
    blocks = list(traits._blocks([batch.slice(0, 100), batch.slice(100)], m, 150))
    assert len(blocks) > 1
    want, got = np.zeros((size, m)), np.zeros((size, m))
    for x, w, v in zip(lists, weights, y * share[:, None]):
        want[x] += w[:, None] * v
    for block in blocks:
        for terms, at, w, sizes, v, s in ((t, a, w, n, v, s) for t, a, n, w, v, s in traits._unpacked(block, m)):
            traits._spread(got, terms, at, w, sizes, v * s)
    assert np.abs(got - want).max() < 1e-12
    rows = spark.createDataFrame([(i % size, float(i)) for i in (3, 59_999, 3, 17, 40_000)], "at long, x double").repartition(3)

    def add(batch, held):
        np.add.at(held, batch.column(0).to_numpy(), np.stack([batch.column(1).to_numpy()] * 5, axis=1))

    summed = passes.total(rows, add, (size, 5))
    assert np.flatnonzero(summed.any(axis=1)).tolist() == [3, 17, 40_000, 59_999] and summed[3].tolist() == [6.0] * 5
    assert passes.total(rows, lambda batch, held: held.__iadd__(1), (2, 3), step=1).tolist() == [[5.0] * 3] * 2  # whole pieces
    words = traits.term_counts(spark.createDataFrame([(1, "The X a_1 ÀÉ x́ naïvé-be and 7 22 22")], "__row long, t string"), "t")
    assert "array_contains" not in words._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.term, r.tf) for r in words.collect()) == sorted([("a_1", 1), ("àé", 1), ("x́", 1), ("naïvé", 1), ("22", 2)])
