"""Gapless ids, bucketed tables, ingest in drops, stored reports and tolerant JSON."""

import json

import pytest
from assayer.functions.json import balanced, object_in_text
from assayer.operators import retrieval
from assayer.operators.keys import gapless
from assayer.sources import files, uploads
from assayer.sources.buckets import BucketTable
from assayer.streaming import events, ingest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCX = files.SUFFIXES[".docx"][0]


@pytest.mark.parametrize("tasks", [1, 32])
def test_ids_are_the_same_on_any_number_of_tasks(spark, tasks):
    rows = [(f"f{i * 7 % 50}", None if i % 9 == 0 else i % 4, i) for i in range(300)] + [(None, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "name string, kind int, `odd col` int").repartition(tasks)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = [tuple(r) for r in gapless(df, ["name"], 1000).orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    first = lambda v: (v is not None, v or 0)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", first(r[1]), r[2]))
    assert got == [(1001 + i, *r) for i, r in enumerate(ordered)]
    assert gapless(df.limit(0), ["name"]).count() == 0


def test_uploads_follow_the_largest_id(spark, tmp_path):
    folder = str(tmp_path / "u")
    rows = spark.createDataFrame([("b.pdf", "application/pdf", 1), ("a.docx", DOCX, 2), ("c.exe", "application/pdf", 3), ("a.docx", DOCX, 4), (None, None, 5)], "filename string, mime_type string, size int")
    inserted, refused = uploads.insert_uploads(spark, folder, rows, start=7)
    assert [(r.id, r.stored, r["size"]) for r in inserted.orderBy("id").collect()] == [(8, "8_a.docx", 2), (9, "9_a.docx", 4), (10, "10_b.pdf", 1)]
    assert refused.count() == 2
    uploads.insert_uploads(spark, folder, rows.where("size = 1"))
    uploads.insert_uploads(spark, folder, rows.limit(0))
    assert sorted(r.id for r in uploads.uploads(spark, folder).collect()) == [8, 9, 10, 11]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_replacement_by_id(spark, tmp_path, fmt):
    folder, schema = tmp_path / "t", StructType.fromDDL("k long, v string, `a b` int")
    table = BucketTable(spark, str(folder), schema, "k", 4, fmt)
    make = lambda rows: spark.createDataFrame(rows, schema)
    assert table.rows().count() == 0
    table.replace(make([]))
    table.replace(make([(i, "old", i) for i in range(200)] + [(None, "none", 1)]))
    change = make([(3, "new", 1), (3, "new", 2), (500, "more", 0), (None, "nil", 2)])
    gone = spark.createDataFrame([(4,), (9999,)], "k long")
    for _ in range(2):  # a second time changes nothing
        table.replace(change, gone)
        got = sorted((tuple(r) for r in table.rows().collect()), key=str)
        assert got == sorted([*((i, "old", i) for i in range(200) if i not in (3, 4)), (3, "new", 1), (3, "new", 2), (500, "more", 0), (None, "nil", 2)], key=str)
    assert len([p for p in folder.iterdir() if p.name.startswith("bucket=")]) <= 4
    assert sorted(r.v for r in table.of(spark.createDataFrame([(3,), (None,), (7,)], "k long")).collect()) == ["new", "new", "nil", "old"]
    table.replace(make([]), table.rows().select("k"))
    assert table.rows().count() == 0 and not [p for p in folder.iterdir() if p.name.startswith("bucket=")]


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = tmp_path / "t"
    table = BucketTable(spark, str(folder), StructType.fromDDL("k long"), "k", 8)
    table.replace(spark.range(100).select(F.col("id").alias("k")))
    stamp = lambda: {p.parent.name: p.stat().st_mtime_ns for p in folder.glob("bucket=*/*.parquet")}
    before = stamp()
    table.replace(spark.range(1).select(F.col("id").alias("k")))
    after = stamp()
    assert sum(before[b] != after[b] for b in before) == 1


def test_reading_by_id_prunes_buckets(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), StructType.fromDDL("resume_id long, chunk_id long, embedding array<double>"), "resume_id", 8)
    table.replace(spark.createDataFrame([(i % 40, i, [float(i % 7), 1.0]) for i in range(400)], table.schema))
    asked = spark.createDataFrame([(1, 3, [1.0, 0.5]), (2, 17, [-1.0, 0.0])], "query_id long, resume_id long, query array<double>")
    asked.write.parquet(str(tmp_path / "q"))
    asked = spark.read.parquet(str(tmp_path / "q")).where("resume_id < 100")
    top = retrieval.index_topk(asked, table.of(asked), 3)
    assert "dynamicpruning" in top._jdf.queryExecution().executedPlan().toString()
    want = []
    for q, owner, (x, y) in ((1, 3, (1.0, 0.5)), (2, 17, (-1.0, 0.0))):
        best = sorted((-(x * (i % 7) + y), i) for i in range(400) if i % 40 == owner)[:3]
        want += [(q, i, rank, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r.chunk_id, r["rank"], r.score) for r in top.collect()) == sorted(want)


def test_ingest_in_drops(spark, tmp_path):
    shape = StructType.fromDDL("resume_id long, text string, n int")
    index = BucketTable(spark, str(tmp_path / "i"), StructType.fromDDL("resume_id long, word string, sha string, n int"), "resume_id", 4)
    seen = []

    def make(rows):
        seen.append(sorted(r.resume_id for r in rows.collect()))
        return rows.select("resume_id", F.explode(F.split("text", " ")).alias("word"), "sha", "n")

    def drop(*rows):
        spark.createDataFrame(rows, shape).write.mode("append").parquet(str(tmp_path / "d"))
        ingest.ingest_drops(spark, str(tmp_path / "d"), shape, index, make, str(tmp_path / "c"), order="n")

    drop((1, "a b", 0), (2, "c", 0), (2, "d", 1), (3, "e", 0))
    drop((1, "a b", 5), (3, "f g", 5), (4, None, 5))
    assert seen == [[1, 2, 3], [3, 4]]  # the first's second coming is unchanged
    rows = sorted((r.resume_id, r.word, r.n) for r in index.rows().collect())
    assert rows == [(1, "a", 0), (1, "b", 0), (2, "d", 1), (3, "f", 5), (3, "g", 5)]
    assert not index.once(1, index.rows().limit(0), index.rows().select("resume_id"))  # a batch that comes again
    assert sorted((r.resume_id, r.word, r.n) for r in index.rows().collect()) == rows


def test_late_events_and_a_restart(spark, tmp_path):
    shape = StructType.fromDDL("ts timestamp_ntz, event_type string")
    folder, days, signs = (str(tmp_path / n) for n in ("e", "d", "c"))

    def drop(*stamps):
        spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp_ntz").alias("ts"), F.lit("x").alias("event_type")).write.mode("append").parquet(folder)
        events.daily_counts_of_folder(spark, folder, shape, signs, days).awaitTermination()
        return {r.day: r["count"] for r in spark.read.schema("day string, event_type string, count long").parquet(days).collect()}

    assert drop("2024-01-01 08:00", "2024-01-02 09:00") == {}
    # the first day's state outlives the restart; the second day is open until a day after it has passed
    assert drop("2024-01-01 23:00", "2024-01-04 01:00") == {"2024-01-01": 2, "2024-01-02": 1}
    assert drop("2024-01-01 10:00", "2024-01-02 10:00", "2024-01-03 10:00", "2024-01-09 00:00") == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 1, "2024-01-04": 1}


def test_reports_lie_in_few_folders(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 90, [("a", "Matched")], "s") for i in range(300)], "analysis_id long, overall_score int, requirements array<struct<requirement:string,status:string>>, summary string")
    out = tmp_path / "r"
    files.write_reports(rows, str(out), 8)
    files.write_reports(rows.where("analysis_id < 5").withColumn("overall_score", F.lit(100)), str(out), 8)
    got = {r.analysis_id: r.overall_score for r in files.read_reports(spark, str(out), multi_line=False).collect()}
    assert got == {i: 100 if i < 5 else i % 90 for i in range(300)}
    assert len([p for p in out.iterdir() if p.name.startswith("bucket=")]) <= 8
    with (out / "bucket=0" / "more.json").open("w") as f:
        f.write('{"analysis_id": 400, "overall_score": 1}\n{"analysis_id": 401, "overall\nnothing\n{"analysis_id": 0, "overall_score": 3}\n')
    expected = spark.createDataFrame([(0,), (299,), (400,), (401,), (402,)], "analysis_id long")
    states = {r.analysis_id: (r.state, r.overall_score) for r in files.report_states(expected, files.scan_reports(spark, str(out))).collect()}
    assert states == {0: ("ok", 100), 299: ("ok", 29), 400: ("malformed", None), 401: ("corrupt", None), 402: ("missing", None)}


ANSWERS = [
    ('```json\n{"a": {"b": "}"}}\n```', {"a": {"b": "}"}}), ('x {"a":1} y {"b":2}', {"a": 1}), ('{"a":"\\"{"} tail }', {"a": '"{'}), ("none", None), (None, None), ("", None), ("[1]", None),
    ('pre {"a":[{"b":1}]} post', {"a": [{"b": 1}]}), ('{"a":1', None), ("12", None), ('```\n{"a": 2}```', {"a": 2}), ("a } { b", None), ('{"a": "\\\\"} {', {"a": "\\"}), ('{"k": "' + "{" * 5000 + '"} }', {"k": "{" * 5000}),
]


def test_tolerant_json(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, t string")
    got = {r.i: r.o for r in df.select("i", F.to_json(object_in_text(F.col("t"))).alias("o")).collect()}
    assert [json.loads(got[i]) if got[i] else None for i in range(len(ANSWERS))] == [want for _, want in ANSWERS]
    assert df.where("i = 1").select(balanced(F.col("t")).alias("b")).first().b == '{"a":1}'


def test_texts_are_written_once_per_replacement_and_dealt_once_per_drop(spark, tmp_path, monkeypatch):
    from assayer.streaming import ingest

    table = BucketTable(spark, str(tmp_path / "t"), StructType.fromDDL("k long, text string"), "k", 4)
    table.replace(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], table.schema))
    seen, written = {}, BucketTable.written
    monkeypatch.setattr(BucketTable, "written", lambda self, rows, name: seen.setdefault(name, written(self, rows, name)))
    table.replace(spark.createDataFrame([(2, "new")], table.schema))
    held = [(r.k, r.text) for x in seen.values() if "text" in x.columns for r in x.collect()]
    assert held.count((2, "new")) == 1 and (2, "b") not in held
    assert sorted(table.rows().collect()) == [(1, "a"), (2, "new"), (3, "c")]
    drop = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (2, "b", 0), (2, "c", 0), (None, "n", 0)], "k long, text string, turn int")
    latest = ingest.newest(drop, "k", "text", "turn")
    assert latest._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.k, r.text, r.turn) for r in latest.collect()} == {(1, "y", 1), (2, "c", 0), (None, "n", 0)}
    stored = latest.where("k = 2").select("k", "sha")
    assert [r.k for r in ingest.changed(latest, stored, "k").collect()] == [1]
