"""Aggregates and history search on small seeds."""

from datetime import date, datetime, timedelta

import pytest
from assayer.operators import analytics, dml, search
from pyspark.sql import functions as F

NOW = datetime(2024, 3, 15, 12)
SCHEMA = "id long, resume_id long, jd_id long, overall_score long, coverage_score long, experience_score long, project_score long, quality_score long, workflow_status string, created_at timestamp_ntz"


def seed(spark, scores, when=None, coverage=None):
    rows = []
    for i, x in enumerate(scores):
        at = NOW - timedelta(days=(when[i] if when else 0))
        rows.append((i + 1, i % 2 + 1, 1, x, coverage[i] if coverage else None, None, None, None, None, at))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def files(spark):
    resumes = spark.createDataFrame([(1, "Ann_Lee.pdf"), (2, "bob.docx")], "id long, filename string")
    return resumes, spark.createDataFrame([(1, "Data Engineer.pdf")], "id long, filename string")


def test_statistics(spark):
    r = analytics.overall_statistics(seed(spark, [90, 50, None], coverage=[80, 40, 1])).first()
    assert (r.total, r.average_overall, r.average_coverage, r.average_quality, r.selected, r.rejected) == (2, 70.0, 60.0, 0.0, 1, 1)


def test_empty_input_gives_zero_rows(spark):
    none = seed(spark, [])
    r = analytics.overall_statistics(none).first()
    assert (r.total, r.average_overall, r.selected) == (0, 0.0, 0)
    assert [x["count"] for x in analytics.score_distribution(none).collect()] == [0] * 5
    assert [x.percentage for x in analytics.recommendation_distribution(none).collect()] == [0.0] * 3
    assert analytics.trend(none).count() == 0 and analytics.daily_trend_zero_filled(none).count() == 0
    assert analytics.chart_maxima(none).first().max_count == 1


def test_buckets_and_bands(spark):
    r = analytics.recommendation_counts(seed(spark, [95, 70, 30])).first()
    assert tuple(r) == (1, 1, 1)
    assert [x["count"] for x in analytics.score_distribution(seed(spark, [10, 30, 90, 85])).collect()] == [1, 1, 0, 0, 2]
    many = seed(spark, [i % 101 for i in range(120)])
    assert sum(x["count"] for x in analytics.score_distribution(many).collect()) == 120
    share = {x.recommendation: x.percentage for x in analytics.recommendation_distribution(seed(spark, [95, 90, 40])).collect()}
    assert share["Selected"] == 66.67


def test_trends(spark):
    rows = seed(spark, [1, 2, 3, 4], when=[0, 0, 5, 90])
    daily = {r.period: r["count"] for r in analytics.trend(rows, "daily").collect()}
    assert daily == {"2024-03-15": 2, "2024-03-10": 1}
    full = analytics.daily_trend_zero_filled(seed(spark, [1, 2, 3, 4], when=[0, 0, 7, 40])).collect()
    assert len(full) == 30 and sum(r["count"] for r in full) == 3
    assert analytics.trend(rows, "daily", as_of=datetime(2024, 3, 9)).count() == 2
    with pytest.raises(ValueError):
        analytics.trend(rows, "hourly")


def test_week_key_is_monday_first(spark):
    days = [date(2000, 1, 1) + timedelta(days=i * 7 % 9000) for i in range(600)]
    got = spark.createDataFrame([(x,) for x in days], "d date").select("d", analytics.week_key(F.col("d")).alias("w")).collect()
    assert all(r.w == r.d.strftime("%Y-W%W") for r in got)


def test_top_counts_names_not_ids(spark):
    names = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "id long, filename string")
    rows = seed(spark, [1, 2, 3, None])
    assert [tuple(r) for r in analytics.top_by_filename(rows, names, "resume_id").collect()] == [("same", 3)]


def test_recent_activity(spark, files):
    got = analytics.recent_activity(seed(spark, [30, 70, 95], when=[2, 1, 0]), *files).collect()
    assert [r.overall_score for r in got] == [95, 70, 30]
    assert (got[0].recommendation, got[2].recommendation, got[0].workflow_status) == ("Selected", "Rejected", "Applied")


def test_history(spark, files):
    rows = seed(spark, [60, 90, 75, 85, 10])
    f = search.HistoryFilter(sort="highest_score", page_size=2)
    assert [r.overall_score for r in search.page(rows, *files, f).collect()] == [90, 85]
    assert tuple(search.totals(rows, *files, f).first()) == (5, 3)
    assert search.page(rows, *files, search.HistoryFilter(page=100, page_size=10)).count() == 0
    assert search.matching(rows, *files, search.HistoryFilter(resume_filename="ANN%lee")).count() == 3
    assert search.matching(rows, *files, search.HistoryFilter(recommendation="Borderline", min_score=70)).count() == 1
    assert search.matching(rows, *files, search.HistoryFilter(date_from=date(2024, 3, 15), date_to=date(2024, 3, 15))).count() == 5
    assert tuple(search.totals(rows.where("1=0"), *files, f).first()) == (0, 0)


@pytest.mark.parametrize("bad", [{"min_score": 101}, {"min_score": 9, "max_score": 3}, {"date_from": date(2024, 2, 1), "date_to": date(2024, 1, 1)}, {"page": 0}, {"page_size": 101}, {"recommendation": "Maybe"}])
def test_filters_are_validated(bad):
    with pytest.raises(ValueError):
        search.HistoryFilter(**bad)


def test_page_numbers():
    assert search.page_numbers(5, 100, 10) == [1, None, 4, 5, 6, None, 10]
    assert search.page_numbers(1, 20, 10) == [1, 2] and search.page_numbers(1, 0, 10) == []


def test_changes(spark):
    log = spark.createDataFrame([(1, 1, "insert", "a", "x", 1), (1, 2, "update", "  ", "y", 2), (2, 1, "insert", "b", "x", 1), (2, 2, "delete", None, None, 3)], "note_id long, seq long, op string, text string, author string, at long")
    assert [tuple(r) for r in dml.latest_notes(log).select("note_id", "text", "author").collect()] == [(1, "a", "y")]
    rows = seed(spark, [1, 2])
    changed = dml.update_status(rows, spark.createDataFrame([(1, "Offer", 1), (1, "Nonsense", 2)], "id long, workflow_status string, seq long"))
    assert {r.id: r.workflow_status for r in changed.collect()} == {1: "Offer", 2: None}
    notes = spark.createDataFrame([(1, 1, "t", "a"), (2, 2, "t", "a"), (3, 9, "t", "a"), (4, 1, " ", "a")], "id long, analysis_id long, text string, author string")
    assert {r.id for r in dml.valid_notes(notes, rows).collect()} == {1, 2}
    left, left_notes = dml.delete_analyses(rows, notes, spark.createDataFrame([(1,)], "id long"))
    assert {r.id for r in left.collect()} == {2} and {r.id for r in left_notes.collect()} == {2, 3}
    once = dml.with_columns_added(rows, {"extra": "double", "id": "long"})
    assert dml.with_columns_added(once, {"extra": "double"}).columns == once.columns == [*rows.columns, "extra"]
    index = spark.createDataFrame([(1, "s1"), (2, None)], "resume_id long, sha string")
    sources = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3")], "resume_id long, sha string")
    assert {r.resume_id for r in dml.stale_sources(sources, index).collect()} == {2, 3}
