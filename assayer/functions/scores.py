"""Score classifications and blends as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import DEFAULTS, LEARNING_BANDS, Settings


def d(x: float) -> Column:
    """A double literal; decimals would change types and truncation."""
    return F.lit(float(x))


def round_half_up(x: Column, places: int = 2) -> Column:
    """floor(x * 10^p + 0.5) / 10^p: the same on every engine."""
    scale = float(10**places)
    return F.floor(x * d(scale) + d(0.5)).cast("double") / d(scale)


def truncated(x: Column) -> Column:
    """Towards zero, as a long."""
    return x.cast("long")


def clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def banded(x: Column, bands, otherwise) -> Column:
    """The label of the first ``(least, label)`` that ``x`` reaches; null when x is null."""
    out = F.when(x.isNull(), F.lit(None))
    for least, label in bands:
        out = out.when(x >= least, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def recommendation(score: Column, s: Settings = DEFAULTS) -> Column:
    """Selected, Borderline or Rejected; an unknown score is Rejected."""
    return F.coalesce(banded(score, ((s.selected_min, "Selected"), (s.borderline_min, "Borderline")), "Rejected"), F.lit("Rejected"))


def fit_category(score: Column) -> Column:
    """The client's own thresholds, which differ from ``recommendation``."""
    return banded(score, ((75, "Selected"), (60, "Borderline")), "Rejected")


def hiring_risk(score: Column) -> Column:
    return banded(score, ((75, "Low"), (60, "Medium")), "High")


def star_rating(score: Column) -> Column:
    return clamp(F.floor(score / d(20) + d(0.5)), 0, 5)


def recommendation_text(score: Column) -> Column:
    return banded(score, ((80, "Highly Recommended - Proceed to Technical Screen"), (60, "Conditional Match - Proceed to Initial Interview")), "Not Recommended - Reject")


def recommendation_tone(text: Column) -> Column:
    """The client's colour for a recommendation's wording."""
    return F.when(text.rlike("(?i)not recommended|reject"), "danger").when(text.rlike("(?i)highly|strong"), "success").when(text.rlike("(?i)conditional|borderline|interview"), "warning").otherwise("neutral")


def section_score(section: Column) -> Column:
    return F.when(section == "Experience", 100).when(section == "Projects", 80).when(section == "Skills", 30).otherwise(0)


def is_narrative(section: Column) -> Column:
    return F.coalesce(section.isin("Experience", "Projects"), F.lit(False))


def density_score(chunk: Column) -> Column:
    n = F.length(F.coalesce(chunk, F.lit("")))
    return F.when(n > 150, 100).when(n > 70, 70).when(n > 30, 30).otherwise(0)


def confidence(cosine: Column, section: Column, density: Column, technical: Column, s: Settings = DEFAULTS) -> Column:
    """The retrieval blend: truncated, then kept within 0 and 100."""
    similarity = F.least(F.greatest(cosine * d(100), d(0)), d(100))
    blend = similarity * d(s.rank_similarity) + section * d(s.rank_section) + density * d(s.rank_density) + technical * d(s.rank_technical)
    return clamp(truncated(blend))


def fallback_confidence(score: Column, section: Column, s: Settings = DEFAULTS) -> Column:
    """For evidence without a stored confidence: fixed density and specificity, 30 for listing sections."""
    place = F.when(section == "Experience", 100).when(section == "Projects", 80).otherwise(30)
    return confidence(F.coalesce(score, d(0)), place, F.lit(30), F.lit(40), s)


def overall_score(coverage: Column, experience: Column, projects: Column, conf: Column, quality: Column, s: Settings = DEFAULTS) -> Column:
    blend = coverage * d(s.weight_coverage) + experience * d(s.weight_experience) + projects * d(s.weight_projects) + conf * d(s.weight_confidence) + quality * d(s.weight_quality)
    return clamp(truncated(blend))


def relation(cosine: Column, same_category_cosine: Column, s: Settings = DEFAULTS) -> Column:
    """equivalent by the best of all skills, related by the best of the same category, else none."""
    return F.when(cosine >= s.equivalent_min, "equivalent").when(same_category_cosine >= s.related_min, "related").otherwise("none")


def learning_time(transfer: Column) -> Column:
    return banded(transfer, [(least, time) for least, time, _ in LEARNING_BANDS], LEARNING_BANDS[-1][1])


def stuffing_risk(claimed: Column, over_claimed: Column, s: Settings = DEFAULTS) -> Column:
    share = over_claimed / F.nullif(claimed, F.lit(0))
    return F.when(claimed == 0, "Low").when(share >= s.stuffing_high, "High").when(share >= s.stuffing_medium, "Medium").otherwise("Low")


def seniority_level(years: Column) -> Column:
    return banded(years, ((8.0, "Lead"), (5.0, "Senior"), (2.0, "Mid")), "Junior")


def seniority_fit(total: Column, required: Column) -> Column:
    return F.when(total.isNull() | required.isNull(), "Unknown").when(total >= required + 2, "Exceeds").when(total >= required, "Meets").otherwise("Below")


def trait_scale(prediction: Column) -> Column:
    """A predicted trait on a scale of 0 to 10."""
    return F.least(F.greatest(round_half_up((prediction + d(1)) * d(5)), d(0)), d(10))


def or_default(x: Column, default: str) -> Column:
    """Null and empty alike give the default."""
    return F.when(x.isNull() | (x == ""), F.lit(default)).otherwise(x)


def trimmed_or_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def week_key(ts: Column) -> Column:
    """Year and Monday-first week 00-53 (not ISO)."""
    week = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def fingerprint(content: Column) -> Column:
    """First half of the SHA-256 of a file's content; empty for a missing one."""
    return F.coalesce(F.substring(F.sha2(content.cast("binary"), 256), 1, 32), F.lit(""))


def csv_field(x: Column) -> Column:
    """Quoted when it holds a quote, comma or line break; null is empty."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
