"""Filtered, sorted and paged history."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import or_default, recommendation
from ..settings import DEFAULTS, Settings
from .analytics import completed, star

SORTS = {"newest": ("created_at", True), "oldest": ("created_at", False), "highest_score": ("overall_score", True), "lowest_score": ("overall_score", False)}


@dataclass(frozen=True)
class HistoryFilter:
    """Only what is set restricts. ``%`` and ``_`` in names stay wildcards."""

    resume_filename: str | None = None
    jd_filename: str | None = None
    recommendation: str | None = None
    min_score: int | None = None
    max_score: int | None = None
    date_from: date | None = None
    date_to: date | None = None
    sort: str = "newest"
    page: int = 1
    page_size: int = 20

    def __post_init__(self):
        for bound in (self.min_score, self.max_score):
            if bound is not None and not 0 <= bound <= 100:
                raise ValueError("scores lie between 0 and 100")
        if self.min_score is not None and self.max_score is not None and self.min_score > self.max_score:
            raise ValueError("min_score is above max_score")
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from is after date_to")
        if self.page < 1 or not 1 <= self.page_size <= 100:
            raise ValueError("pages start at 1 and hold 1 to 100 rows")
        if self.recommendation not in (None, "Selected", "Borderline", "Rejected"):
            raise ValueError("unknown recommendation")

    def predicates(self, s: Settings = DEFAULTS) -> list[Column]:
        score, created = F.col("overall_score"), F.col("created_at")
        like = lambda c, p: F.lower(c).like(f"%{p.lower()}%")
        ranges = {"Selected": score >= s.selected_min, "Borderline": (score >= s.borderline_min) & (score < s.selected_min), "Rejected": score < s.borderline_min}
        wanted = [
            (self.resume_filename, lambda: like("resume_filename", self.resume_filename)),
            (self.jd_filename, lambda: like("jd_filename", self.jd_filename)),
            (self.recommendation, lambda: ranges[self.recommendation]),
            (self.min_score, lambda: score >= self.min_score),
            (self.max_score, lambda: score <= self.max_score),
            (self.date_from, lambda: created >= F.lit(self.date_from).cast("timestamp_ntz")),
            (self.date_to, lambda: created < F.date_add(F.lit(self.date_to), 1).cast("timestamp_ntz")),
        ]
        return [make() for value, make in wanted if value is not None and value != ""]


def matching(analyses: DataFrame, resumes: DataFrame, jobs: DataFrame, f: HistoryFilter, s: Settings = DEFAULTS) -> DataFrame:
    joined = star(completed(analyses), resumes, jobs)
    return reduce(DataFrame.where, f.predicates(s), joined)


def ordered(rows: DataFrame, sort: str) -> DataFrame:
    """The chosen column with the id as tie-break in the same direction; unknown sorts mean newest."""
    column, down = SORTS.get(sort, SORTS["newest"])
    return rows.orderBy(*(F.desc(c) if down else F.asc(c) for c in (column, "id")))


def page(analyses: DataFrame, resumes: DataFrame, jobs: DataFrame, f: HistoryFilter, s: Settings = DEFAULTS) -> DataFrame:
    """One page; past the end it is empty. Planned as a single top-k with offset."""
    rows = ordered(matching(analyses, resumes, jobs, f, s), f.sort).offset((f.page - 1) * f.page_size).limit(f.page_size)
    return rows.select("id", "resume_filename", "jd_filename", "overall_score", recommendation(F.col("overall_score"), s).alias("recommendation"), or_default(F.col("workflow_status"), "Applied").alias("workflow_status"), "created_at")


def totals(analyses: DataFrame, resumes: DataFrame, jobs: DataFrame, f: HistoryFilter, s: Settings = DEFAULTS) -> DataFrame:
    """Rows that match and pages they fill (0 when none)."""
    return matching(analyses, resumes, jobs, f, s).agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / F.lit(f.page_size)).cast("long").alias("pages"))


def page_numbers(current: int, total: int, size: int) -> list[int | None]:
    """First, neighbours of the current one, last; None for a gap."""
    last = math.ceil(total / size)
    shown = sorted({p for p in (1, current - 1, current, current + 1, last) if 1 <= p <= last})
    return [x for a, b in zip([0, *shown], shown) for x in ([b] if b - a <= 1 else [None, b])]


def lookup(rows: DataFrame, id_: int) -> DataFrame:
    """The row of a primary key, or none; the predicate reaches the scan."""
    return rows.where(F.col("id") == id_).limit(1)
