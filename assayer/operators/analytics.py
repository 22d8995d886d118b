"""Aggregates over scored analyses. ``overall_score IS NOT NULL`` means completed.

All take ``analyses (id, resume_id, jd_id, overall_score, coverage_score,
experience_score, project_score, quality_score, created_at, ...)``. Empty input
still gives the rows of zeros that a dashboard shows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import or_default, recommendation, round_half_up, week_key
from ..settings import DEFAULTS, SCORE_BANDS, Settings
from .retrieval import ranked

SUB_SCORES = ("overall", "coverage", "experience", "project", "quality")


def completed(analyses: DataFrame) -> DataFrame:
    return analyses.where(F.col("overall_score").isNotNull())


def _buckets(s: Settings) -> dict[str, Column]:
    score = F.col("overall_score")
    return {
        "selected": F.count_if(score >= s.selected_min),
        "borderline": F.count_if((score >= s.borderline_min) & (score < s.selected_min)),
        "rejected": F.count_if(score < s.borderline_min),
    }


def recommendation_counts(analyses: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return completed(analyses).agg(*(c.alias(n) for n, c in _buckets(s).items()))


def overall_statistics(analyses: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    averages = [F.coalesce(round_half_up(F.avg(f"{n}_score")), F.lit(0.0)).alias(f"average_{n}") for n in SUB_SCORES]
    return completed(analyses).agg(F.count("id").alias("total"), *averages, *(c.alias(n) for n, c in _buckets(s).items()))


def dashboard_overview(analyses: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return overall_statistics(analyses, s).select(
        F.col("total").alias("total_candidates"), "average_overall", F.col("average_coverage").alias("average_skill_score"), F.col("average_experience").alias("average_experience_score"), "selected", "borderline", "rejected"
    )


def _long(wide: DataFrame, pairs: list[tuple[str, str]], label: str, value: str) -> DataFrame:
    """One row per (label, column) pair of a one-row frame."""
    cells = F.array(*[F.struct(F.lit(name).alias(label), F.col(column).alias(value)) for name, column in pairs])
    return wide.select("*", F.inline(cells))


def recommendation_distribution(analyses: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    wide = recommendation_counts(analyses, s).withColumn("total", F.col("selected") + F.col("borderline") + F.col("rejected"))
    share = F.coalesce(round_half_up(F.col("count") / F.nullif("total", F.lit(0)) * 100), F.lit(0.0))
    return _long(wide, [("Selected", "selected"), ("Borderline", "borderline"), ("Rejected", "rejected")], "recommendation", "count").select("recommendation", "count", share.alias("percentage"))


def score_distribution(analyses: DataFrame) -> DataFrame:
    """All bands with bounds, count and the total of all bands."""
    names = [f"b{i}" for i in range(len(SCORE_BANDS))]
    wide = completed(analyses).agg(*(F.count_if(F.col("overall_score").between(low, high)).alias(n) for n, (_, low, high) in zip(names, SCORE_BANDS)))
    wide = wide.withColumn("total", reduce(Column.__add__, [F.col(n) for n in names]))
    cells = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(low).cast("long").alias("min_score"), F.lit(high).cast("long").alias("max_score"), F.col(n).alias("count")) for n, (label, low, high) in zip(names, SCORE_BANDS)])
    return wide.select(F.inline(cells), "total")


GRAINS = {"daily": lambda ts: F.date_format(ts, "yyyy-MM-dd"), "weekly": week_key, "monthly": lambda ts: F.date_format(ts, "yyyy-MM")}


def _as_of(analyses: DataFrame, as_of) -> Column:
    """The given moment, or the latest creation: never the wall clock, so that results repeat."""
    return F.lit(as_of).cast("timestamp_ntz") if as_of is not None else analyses.agg(F.max("created_at").cast("timestamp_ntz")).scalar()


def window_start(grain: str, now: Column, s: Settings = DEFAULTS) -> Column:
    if grain == "daily":
        return (F.to_date(now) - F.make_dt_interval(F.lit(s.daily_days - 1))).cast("timestamp_ntz")
    return now - F.make_dt_interval(F.lit(s.weekly_weeks * 7 if grain == "weekly" else s.monthly_months * 31))


def trend(analyses: DataFrame, grain: str = "daily", as_of=None, s: Settings = DEFAULTS) -> DataFrame:
    """``(period, count)`` of completed analyses in the grain's window, non-empty periods, ascending."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain}")
    rows = completed(analyses).where(F.col("created_at") >= window_start(grain, _as_of(analyses, as_of), s))
    return rows.groupBy(GRAINS[grain](F.col("created_at")).alias("period")).agg(F.count(F.lit(1)).alias("count")).orderBy("period")


def trend_bundle(analyses: DataFrame, as_of=None, s: Settings = DEFAULTS) -> DataFrame:
    return reduce(DataFrame.union, [trend(analyses, g, as_of, s).select(F.lit(g).alias("grain"), "period", "count") for g in GRAINS]).orderBy("grain", "period")


def daily_trend_zero_filled(analyses: DataFrame, as_of=None, s: Settings = DEFAULTS) -> DataFrame:
    """Every day of the window, days without analyses with 0."""
    spine = analyses.sparkSession.range(1).select(_as_of(analyses, as_of).alias("now")).where("now IS NOT NULL")
    days = spine.select(F.explode(F.sequence(F.to_date(window_start("daily", F.col("now"), s)), F.to_date("now"))).alias("day")).select(F.date_format("day", "yyyy-MM-dd").alias("period"))
    return days.join(F.broadcast(trend(analyses, "daily", as_of, s)), "period", "left").select("period", F.coalesce("count", F.lit(0)).alias("count")).orderBy("period")


def top_by_filename(analyses: DataFrame, files: DataFrame, key: str, limit: int = DEFAULTS.top_limit) -> DataFrame:
    """Completed analyses per file name (not per id): count descending, name ascending.

    Counts are made per id first, so the join sees one row per id.
    """
    per_id = completed(analyses).groupBy(F.col(key).alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
    named = per_id.join(files.select(F.col("id").alias("file_id"), "filename"), "file_id")
    return named.groupBy("filename").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "filename").limit(limit)


def star(analyses: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Analyses with both file names; rows without either are dropped, as in an inner join."""
    r = resumes.select(F.col("id").alias("resume_id"), F.col("filename").alias("resume_filename"))
    j = jobs.select(F.col("id").alias("jd_id"), F.col("filename").alias("jd_filename"))
    return analyses.join(r, "resume_id").join(j, "jd_id")


def recent_activity(analyses: DataFrame, resumes: DataFrame, jobs: DataFrame, limit: int = DEFAULTS.recent_limit, s: Settings = DEFAULTS) -> DataFrame:
    """Newest first, of the analyses whose files exist: the joins come before the limit."""
    rows = star(completed(analyses), resumes, jobs).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return rows.select("id", "resume_filename", "jd_filename", "overall_score", recommendation(F.col("overall_score"), s).alias("recommendation"), or_default(F.col("workflow_status"), "Applied").alias("workflow_status"), "created_at")


def skill_frequency(reports: DataFrame, limit: int = DEFAULTS.top_limit) -> DataFrame:
    """``(kind, skill, count)``: most frequent missing and matched skills of nested reports; ties by name."""
    matched = F.transform(F.filter("requirements", lambda r: r["status"] == "Matched"), lambda r: r["requirement"])
    out = []
    for kind, skills in (("missing", F.col("missing_skills")), ("matched", matched)):
        named = reports.select(F.explode(skills).alias("skill")).select(F.trim("skill").alias("skill")).where("skill <> ''")
        out.append(named.groupBy("skill").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "skill").limit(limit).select(F.lit(kind).alias("kind"), "skill", "count"))
    return out[0].union(out[1])


def verdict_frequency(verdicts: DataFrame, limit: int = DEFAULTS.top_limit) -> DataFrame:
    """``skill_frequency`` from the rows of verdicts themselves: one count by status and name, no report is built."""
    kind = F.when(F.col("status") == "Missing", "missing").when(F.col("status") == "Matched", "matched")
    named = verdicts.select(kind.alias("kind"), F.trim("requirement").alias("skill")).where("kind IS NOT NULL AND skill <> ''")
    counted = named.groupBy("kind", "skill").agg(F.count(F.lit(1)).alias("count"))
    return ranked(counted, ["kind"], [F.desc("count"), F.asc("skill")], "r", limit).drop("r")


def chart_maxima(analyses: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The client's chart scale and whole-number shares."""
    top = score_distribution(analyses).agg(F.greatest(F.lit(1), F.max("count")).alias("max_count"), F.max("total").alias("total"))
    counts = recommendation_counts(analyses, s)
    share = lambda c: F.floor(F.coalesce(F.col(c) / F.nullif("total", F.lit(0)), F.lit(0.0)) * 100 + 0.5)
    return top.select("max_count", "total", counts.select("selected").scalar().alias("selected"), counts.select("rejected").scalar().alias("rejected")).select("max_count", share("selected").alias("selected_share"), share("rejected").alias("rejected_share"))
