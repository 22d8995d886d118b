"""Identity and seniority from the text of a resume and a job description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import seniority_fit, seniority_level
from .requirements import content_lines

# Words that mark a line as a job title, and how years are written.
ROLE = "(?i)(engineer|developer|programmer|architect|analyst|manager|designer|scientist|administrator|consultant|specialist|lead|director|intern|devops|sre|researcher|scrum master|product owner|technician)"
YEARS_PHRASE = r"(?i)(\d{1,9}(?:\.\d{1,9})?)\s*\+?\s*years?"
YEAR = r"\b((?:19|20)\d{2})\b"


def first_lines(text: Column, n: int = 8) -> Column:
    return F.slice(F.filter(content_lines(text), lambda x: ~x.rlike(r"(?i)^---\s*PAGE")), 1, n)


def name(lines: Column) -> Column:
    """Of the first three lines the first of one to four plain words that is no contact line or title."""

    def plain(x: Column) -> Column:
        words = F.split(x, r"\s+")
        return ~x.rlike(r"@|\d|(?i)http") & F.size(words).between(1, 4) & F.forall(words, lambda w: w.rlike(r"^[A-Za-z.'’-]+$")) & ~x.rlike(ROLE)

    return F.try_element_at(F.filter(F.slice(lines, 1, 3), plain), F.lit(1))


def title(lines: Column) -> Column:
    """Of the first six lines the first with a role word and at most six words."""
    return F.try_element_at(F.filter(F.slice(lines, 1, 6), lambda x: x.rlike(ROLE) & (F.size(F.split(x, r"\s+")) <= 6)), F.lit(1))


def stated_years(text: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEARS_PHRASE), 1), lambda x: x.cast("double")))


def total_years(text: Column) -> Column:
    """The largest stated number of years, else the span of the years named if it is 1 to 50."""
    named = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEAR), 1), lambda x: x.cast("int"))
    span = F.array_max(named) - F.array_min(named)
    return F.coalesce(stated_years(text), F.when((span > 0) & (span <= 50), span.cast("double")))


def profiles(rows: DataFrame, resume: str = "resume_text", job: str = "jd_text") -> DataFrame:
    """``rows`` with name, title, total_years, seniority_level, required_years, seniority_fit and a sentence on it."""
    lines = rows.withColumn("__lines", first_lines(F.col(resume))).withColumns({"total_years": total_years(F.col(resume)), "required_years": stated_years(F.col(job))})
    out = lines.withColumns({"name": name(F.col("__lines")), "title": title(F.col("__lines")), "seniority_level": seniority_level(F.col("total_years")), "seniority_fit": seniority_fit(F.col("total_years"), F.col("required_years"))})
    said = F.when(F.col("total_years").isNull(), "The resume does not tell the years of experience.").when(F.col("required_years").isNull(), F.format_string("About %.1f years (%s); none are asked for.", "total_years", "seniority_level")).otherwise(F.format_string("About %.1f years (%s) against %.1f asked for: %s.", "total_years", "seniority_level", "required_years", F.lower("seniority_fit")))
    return out.withColumn("explanation", said).drop("__lines")
