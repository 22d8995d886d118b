"""Verdicts, sub-scores, authenticity, leaderboards and reports.

Evidence is relational: ``requirements (analysis_id, requirement, importance,
weight, position)`` and ``matches (analysis_id, requirement, chunk, section,
score, confidence)``. Nested reports are built only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.scores import d
from ..settings import DEFAULTS, PARTIAL_LEARNING_TIME, Settings
from .retrieval import ranked

KEY = ["analysis_id", "requirement"]


def best_matches(matches: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Per requirement: the most confident match (its score in percent where no confidence is
    stored; ties by section, then text), and the best one from a narrative section, if any."""
    known = F.col("confidence").cast("long")
    rows = matches.withColumn("key", F.coalesce(known.cast("double"), F.col("score") * 100, d(0)))
    rows = rows.withColumn("confidence", F.coalesce(known, S.fallback_confidence(F.col("score"), F.col("section"), s)))
    order = F.struct("key", "section", "chunk", "confidence")
    narrative = S.is_narrative(F.col("section"))
    return rows.groupBy(*KEY).agg(F.max(order).alias("best"), F.max(F.when(narrative, order)).alias("shown"))


def verdicts(requirements: DataFrame, matches: DataFrame, relations: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """One row per requirement with status, confidence, section and evidence.

    ``relations (analysis_id, requirement, related_skill, cosine, relation,
    narrative, skill_chunk)`` lets an equivalent skill meet a requirement that
    has no evidence; a related one is noted and stays missing.
    """
    rows = requirements.join(best_matches(matches, s), KEY, "left")
    if relations is None:
        absent = {"related_skill": "string", "cosine": "double", "relation": "string", "narrative": "boolean", "skill_chunk": "string"}
        rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in absent.items()})
    else:
        rows = rows.join(relations, KEY, "left")
    found, rescued = F.col("best").isNotNull(), F.col("relation") == "equivalent"
    status = F.when(found, F.when(F.col("best.confidence") >= s.matched_min, "Matched").otherwise("Partial")).when(rescued, F.when(F.col("narrative"), "Matched").otherwise("Partial")).otherwise("Missing")
    return rows.select(
        *KEY, "position", "importance", "weight", "related_skill", F.coalesce("relation", F.lit("none")).alias("relation"),
        status.alias("status"),
        F.when(found, F.col("best.confidence")).when(rescued, S.truncated(F.col("cosine") * 100)).otherwise(F.lit(0)).cast("long").alias("confidence"),
        F.when(found, F.col("best.section")).alias("section"),
        F.when(found, F.col("best.chunk")).when(rescued, F.col("skill_chunk")).otherwise("").alias("evidence"),
        (found | F.coalesce(rescued, F.lit(False))).alias("covered"), found.alias("claimed"), F.col("shown").isNotNull().alias("demonstrated"),
        F.when(F.col("shown").isNotNull(), S.density_score(F.col("shown.chunk"))).alias("depth"), F.col("cosine").alias("transfer"), F.coalesce("narrative", F.lit(False)).alias("narrative"),
    )


def _coverage() -> Column:
    """Share of the requirements' weight that is covered, truncated to whole percent; 0 without
    weight. Noise of the order of summation is rounded off before the cut."""
    share = F.sum(F.when(F.col("covered"), F.col("weight")).otherwise(d(0))) / F.nullif(F.sum("weight"), d(0))
    return F.coalesce(S.truncated(S.round_half_up(share * 100, 6)), F.lit(0)).alias("coverage_score")


def _claims() -> list[Column]:
    return [F.count_if("claimed").alias("claimed"), F.count_if("demonstrated").alias("demonstrated"), F.coalesce(F.avg("depth"), d(0)).alias("depth")]


def _rated(counted: DataFrame, s: Settings) -> DataFrame:
    """Ratio, credibility, stuffing risk and quality beside the counts of ``_claims``."""
    ratio = S.round_half_up(F.coalesce(F.col("demonstrated") / F.nullif("claimed", F.lit(0)), d(0)))
    rated = counted.withColumn("corroboration_ratio", ratio).withColumn("credibility_score", F.bround(F.col("corroboration_ratio") * 100).cast("long"))
    quality = F.bround(F.col("credibility_score") * d(s.quality_corroboration) + F.col("depth") * d(s.quality_depth)).cast("long")
    risk = S.stuffing_risk(F.col("claimed"), F.col("claimed") - F.col("demonstrated"), s)
    return rated.withColumns({"keyword_stuffing_risk": risk, "quality_score": S.clamp(quality)}).drop("depth")


def weighted_coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("analysis_id").agg(_coverage())


def authenticity(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Claimed against demonstrated skills: ratio, credibility, stuffing risk and quality."""
    return _rated(rows.groupBy("analysis_id").agg(*_claims()), s)


def _sums() -> list[Column]:
    """What ``_scored`` takes, summed over an analysis."""
    whole = lambda c: S.truncated(c * 100)
    share = lambda section: whole(F.count_if(F.col("section") == section) / F.count(F.lit(1)))
    return [
        share("Experience").alias("experience_score"), share("Projects").alias("project_score"),
        S.truncated(F.coalesce(F.avg(F.when(F.col("covered"), F.col("confidence"))), d(0))).alias("confidence_score"),
        *(F.count_if(F.col("status") == n).alias(f"{n.lower()}_count") for n in ("Matched", "Partial", "Missing")),
        _coverage(), *_claims(),
    ]


def _scored(parts: DataFrame, s: Settings) -> DataFrame:
    scored = _rated(parts, s)
    overall = S.overall_score(F.col("coverage_score"), F.col("experience_score"), F.col("project_score"), F.col("confidence_score"), F.col("quality_score"), s)
    return scored.withColumn("overall_score", overall).withColumn("recruiter_recommendation", S.recommendation_text(overall))


def sub_scores(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """All scores of each analysis from its verdicts, in one aggregate."""
    return _scored(rows.groupBy("analysis_id").agg(*_sums()), s)


def status_counts(reports: DataFrame) -> DataFrame:
    """Requirements of each status in nested reports; an unknown status counts as missing."""
    n = lambda *names: F.size(F.filter("requirements", lambda r: r["status"].isin(*names))).cast("long")
    return reports.select("analysis_id", n("Matched").alias("matched"), n("Partial").alias("partial"), (F.size("requirements") - n("Matched", "Partial")).cast("long").alias("missing"))


GAP = "status = 'Missing' OR status = 'Partial' AND claimed"


def _listed(entry: Column, where: Column | None = None) -> Column:
    """The entries of an analysis in order, of those rows for which ``where`` holds."""
    return F.array_sort(F.collect_list(entry if where is None else F.when(where, entry)))


def gaps(rows: DataFrame) -> DataFrame:
    """Verdicts that leave something to learn: missing ones, and partial ones of the requirement's own name.
    What an equivalent skill meets is no gap, even where that skill is only listed."""
    return rows.where(GAP)


def _learning() -> tuple[Column, Column]:
    time = F.when(F.col("status") == "Partial", PARTIAL_LEARNING_TIME).otherwise(S.learning_time(F.when(F.col("relation") == "related", F.col("transfer")).otherwise(d(0))))
    reason = (
        F.when(F.col("status") == "Partial", F.format_string("%s is named; a project with it would show it.", "requirement"))
        .when(F.col("relation") == "related", F.format_string("%s is close, which shortens the way to %s.", "related_skill", "requirement"))
        .otherwise(F.format_string("Nothing close to %s is shown, so it starts from the basics.", "requirement"))
    )
    return time.alias("estimated_time"), reason.alias("reason")


def learning_roadmap(rows: DataFrame) -> DataFrame:
    """How long each gap would take to learn, and why."""
    return gaps(rows).select(*KEY, "position", *_learning())


def _relationships() -> Column:
    text = (
        F.when(F.col("claimed") & F.col("narrative") & F.col("relation").isin("equivalent", "related"), F.format_string("Work with %s backs %s.", "related_skill", "requirement"))
        .when(~F.col("claimed") & (F.col("relation") == "equivalent"), F.format_string("%s counts as %s.", "related_skill", "requirement"))
        .when(~F.col("claimed") & (F.col("relation") == "related"), F.format_string("%s is a short way from %s.", "requirement", "related_skill"))
    )
    return _listed(F.struct("position", "requirement", text.alias("text")), text.isNotNull())["text"]


def skill_relationships(rows: DataFrame) -> DataFrame:
    """``(analysis_id, skill_relationships)``: what a candidate's other skills mean for the requirements, in their order.

    A close skill backs a claimed requirement if it is shown at work, stands in for one that isn't
    claimed if it is equivalent, and shortens the way to it if it is related.
    """
    return rows.groupBy("analysis_id").agg(_relationships().alias("skill_relationships")).where(F.size("skill_relationships") > 0)


def _questions() -> Column:
    kind = F.when((F.col("status") == "Missing") & (F.col("relation") == "related"), 0).when(F.col("status") == "Partial", 1).when(F.col("status") == "Matched", 2)
    text = (
        F.when(kind == 0, F.format_string("How would you bring what you know of %s to %s?", "related_skill", "requirement"))
        .when(kind == 1, F.format_string("Which problem have you solved with %s, and what came of it?", "requirement"))
        .otherwise(F.format_string("Which hard trade-off have you met in your work with %s?", "requirement"))
    )
    return _listed(F.struct(kind.alias("kind"), F.col("position"), F.col("requirement"), text.alias("text")), kind.isNotNull()).alias("q")


def _chosen_questions() -> Column:
    few = lambda k, n: F.slice(F.transform(F.filter("q", lambda x: x["kind"] == k), lambda x: x["text"]), 1, n)
    first = F.concat(few(0, 3), few(1, 2))
    every = F.concat(first, F.slice(few(2, 2), F.lit(1), F.greatest(F.lit(0), 5 - F.size(first))))
    plain = F.array(F.lit("Walk me through a project you are proud of."), F.lit("When did you last have to learn a tool quickly?"))
    return F.when(F.size(every) > 0, every).otherwise(plain)


def interview_questions(rows: DataFrame) -> DataFrame:
    """``(analysis_id, interview_questions)``: up to three on related skills, two on shallow claims, two on strong ones,
    five in all unless the first two kinds are more; two plain ones where there is nothing to ask."""
    return rows.groupBy("analysis_id").agg(_questions()).select("analysis_id", _chosen_questions().alias("interview_questions"))


def snippet(text: Column, most: int = 90) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis."""
    short = F.regexp_replace(F.trim(text), r"\s+", " ")
    return F.when(F.length(short) > most, F.concat(F.rtrim(F.substring(short, 1, most)), F.lit("…"))).otherwise(short)


def explained(rows: DataFrame) -> DataFrame:
    """Verdicts with a sentence on each: what is shown, and what is missing."""
    quote = snippet(F.col("evidence"))
    text = (
        F.when((F.col("relation") == "equivalent") & ~F.col("claimed"), F.format_string("%s stands in for %s: the two are used alike.", "related_skill", "requirement"))
        .when(F.col("status") == "Matched", F.format_string('Shown at work in %s: "%s".', "section", quote))
        .when(F.col("status") == "Partial", F.format_string("%s is named, but no project shows it at work.", "requirement"))
        .when(F.col("relation") == "related", F.format_string("Not shown; %s is close to it.", "related_skill"))
        .otherwise("Not shown, and nothing close to it either.")
    )
    limits = F.when(F.col("status") == "Matched", "None").when(F.col("status") == "Partial", F.format_string("How deep %s goes is open.", "requirement")).otherwise("A gap.")
    return rows.withColumns({"explanation": text, "limitations": limits})


def _weaknesses(most: int = 5) -> Column:
    must = (F.col("status") == "Missing") & (F.col("importance") == "must")
    text = F.when(must, F.concat(F.lit("Missing must-have: "), "requirement")).when(F.col("status") == "Missing", F.concat(F.lit("Missing nice-to-have: "), "requirement")).otherwise(F.concat("requirement", F.lit(": named, not backed by project work")))
    place = F.struct(F.when(must, 0).otherwise(1).alias("k"), F.when(must, -F.col("position")).otherwise(F.col("position")).alias("p"), text.alias("text"))
    return F.slice(_listed(place, F.expr(GAP))["text"], 1, most)


def weaknesses(rows: DataFrame, most: int = 5) -> DataFrame:
    """``(analysis_id, weaknesses)``: missing must-haves first, the latest in front, then the rest in order."""
    return rows.groupBy("analysis_id").agg(_weaknesses(most).alias("weaknesses")).where(F.size("weaknesses") > 0)


def reports(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Nested reports, one per analysis: scores, requirements in order, strengths and weaknesses, missing skills,
    what other skills mean for them, roadmap, questions, authenticity.

    Verdicts are shuffled once, without the texts that are made of them; all of a report comes from one aggregate.
    """
    rescued = ~F.col("claimed") & (F.col("relation") == "equivalent")
    entry = F.struct("position", "requirement", "status", F.col("evidence").alias("matched_evidence"), "explanation", "limitations", "confidence", "importance", "weight", "related_skill", rescued.alias("rescued"))
    named = lambda *names: F.transform(F.filter("requirements", lambda r: r["status"].isin(*names)), lambda r: r["requirement"])
    strong = F.transform(F.filter("requirements", lambda r: (r["status"] == "Matched") | r["rescued"]), lambda r: F.when(r["rescued"], F.format_string("%s through %s", r["requirement"], r["related_skill"])).otherwise(r["requirement"]))
    gathered = explained(rows.repartition("analysis_id")).groupBy("analysis_id").agg(
        *_sums(),
        _listed(entry).alias("requirements"),
        _listed(F.col("requirement"), F.col("claimed") & ~F.col("demonstrated")).alias("over_claimed_skills"),
        _questions(),
        _listed(F.struct("position", F.col("requirement").alias("skill"), *_learning()), F.expr(GAP)).alias("learning_roadmap"),
        _weaknesses().alias("weaknesses"),
        _relationships().alias("skill_relationships"),
    )
    totals = _scored(gathered, s)
    texts = {"interview_questions": _chosen_questions(), "learning_roadmap": F.when(F.size("learning_roadmap") > 0, F.col("learning_roadmap"))}
    scores = [c for c in totals.columns if c not in ("requirements", "over_claimed_skills", "q", "learning_roadmap", "weaknesses", "skill_relationships")]
    out = totals.withColumns(texts).select(*scores, "requirements", "over_claimed_skills", "interview_questions", "learning_roadmap", "weaknesses", "skill_relationships")
    return out.withColumns({
        "missing_skills": named("Missing"), "strengths": F.slice(strong, 1, 5),
        "authenticity": F.struct("credibility_score", "keyword_stuffing_risk", "over_claimed_skills", "corroboration_ratio"),
        "rejection_email": F.when(F.col("overall_score") < s.matched_min, F.concat(F.lit("We will not go on with this application. Gaps: "), F.array_join(F.slice(named("Partial", "Missing"), 1, 3), ", "))),
    }).drop("over_claimed_skills", "position")


def leaderboard(entries: DataFrame) -> DataFrame:
    """Rank of ``(jd_id, resume_id, position, overall_score, error)``: failures last, score
    descending, input order; a resume given twice counts once, at its first place."""
    once = entries.groupBy("jd_id", "resume_id").agg(F.min_by(F.struct("position", "overall_score", "error"), "position").alias("e")).select("jd_id", "resume_id", "e.*")
    return ranked(once, ["jd_id"], [F.col("error").isNotNull().asc(), F.desc_nulls_last("overall_score"), F.asc("position")])


def requested(resume_ids: DataFrame, resumes: DataFrame) -> DataFrame:
    """Asked-for resumes ``(jd_id, resume_id, position)`` with file names; unknown ones keep a row with an error."""
    named = resume_ids.join(resumes.select(F.col("id").alias("resume_id"), "filename"), "resume_id", "left")
    return named.withColumn("error", F.when(F.col("filename").isNull(), "resume not found"))


def ranking_summary(ranking: DataFrame) -> DataFrame:
    return ranking.groupBy("jd_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("error").isNull()).alias("evaluated"))


def ranking_rows(reports_: DataFrame) -> DataFrame:
    """Flat leaderboard rows of nested reports, with the first five missing skills."""
    return reports_.select("analysis_id", "overall_score", "coverage_score", "experience_score", "project_score", "quality_score", "confidence_score", "recruiter_recommendation", "authenticity.credibility_score", "authenticity.keyword_stuffing_risk", "matched_count", "partial_count", "missing_count", F.slice("missing_skills", 1, 5).alias("top_missing_skills"))


def score_backfill(analyses: DataFrame, report_scores: DataFrame) -> DataFrame:
    """Analyses whose missing scores are filled from ``report_scores (id, report_score)``; running it again changes nothing."""
    filled = analyses.join(report_scores, "id", "left")
    return filled.withColumn("overall_score", F.when(F.col("overall_score").isNull() & F.col("report_score").isNotNull(), S.truncated(F.col("report_score"))).otherwise(F.col("overall_score"))).drop("report_score")


def with_priorities(results: DataFrame, priorities: DataFrame, s: Settings = DEFAULTS, by: str = "analysis_id") -> DataFrame:
    """Requirements with importance and weight by ``by`` and lower-cased name; what isn't listed is a must.

    Of priorities that repeat a name the last by ``position`` counts, within its own analysis (or job).
    """
    known = priorities.groupBy(by, F.lower("requirement").alias("key")).agg(F.max_by("importance", "position").alias("importance"), F.max_by("weight", "position").alias("weight"))
    joined = results.withColumn("key", F.lower("requirement")).join(known, [by, "key"], "left")
    return joined.drop("key").withColumns({"importance": F.coalesce("importance", F.lit("must")), "weight": F.coalesce("weight", d(s.weight_must))})


def overlay(fits: DataFrame, scores: DataFrame) -> DataFrame:
    """Reports whose text comes from elsewhere and whose numbers are ours: the right side wins."""
    ours = [c for c in scores.columns if c != "analysis_id"]
    return fits.drop(*[c for c in ours if c in fits.columns]).join(scores, "analysis_id", "left")


def interview_match(questions: DataFrame, requirements: DataFrame) -> DataFrame:
    """The requirement a question is about: the longest name it contains, the first on a tie.

    ``questions (analysis_id, question_id, question)``; both sides meet on the analysis.
    """
    names = requirements.where(F.length("requirement") > 0).select("analysis_id", "requirement", "position", "status", "evidence", "confidence")
    hit = F.instr(F.lower("question"), F.lower("requirement")) > 0
    pairs = questions.join(names, "analysis_id").where(hit)
    best = ranked(pairs, ["analysis_id", "question_id"], [F.desc(F.length("requirement")), F.asc("position")], "r", 1).drop("r", "question")
    return questions.join(best, ["analysis_id", "question_id"], "left")


def interview_answers(matched: DataFrame) -> DataFrame:
    """A verdict and follow-up for each question, from the requirement it is about."""
    status, conf = F.coalesce("status", F.lit("Missing")), F.coalesce("confidence", F.lit(0))
    name = F.coalesce("requirement", F.lit("this area"))
    backed = (status == "Matched") & (F.coalesce("evidence", F.lit("")) != "")
    verdict = F.when(backed, "backed").when(status == "Partial", "shallow").otherwise("gap")
    answer = F.when(backed, F.format_string('Points to work with %s: "%s".', name, "evidence")).when(status == "Partial", F.format_string("Names %s without depth.", name)).otherwise(F.format_string("Has no evidence of %s to draw on.", name))
    lacks = F.when(backed, "The scale of the work and what it changed.").when(status == "Partial", F.format_string("What came of the work with %s.", name)).otherwise(F.format_string("Any work with %s.", name))
    follow = F.when(conf < 60, F.array(F.format_string("Which measurable result did your work with %s have?", name))).otherwise(F.array().cast("array<string>"))
    return matched.select("analysis_id", "question_id", "question", verdict.alias("verdict"), answer.alias("ideal_answer"), F.coalesce("evidence", F.lit("")).alias("evidence"), lacks.alias("missing_information"), conf.cast("long").alias("confidence"), follow.alias("follow_up_questions"))


def interview(reports_: DataFrame, questions: DataFrame, default: str = "Walk me through a project you are proud of.") -> DataFrame:
    """Answers for the questions of each report; a report without any gets the default one."""
    asked = reports_.select("analysis_id").join(questions, "analysis_id", "left")
    asked = asked.withColumns({"question_id": F.coalesce("question_id", F.lit(0)), "question": F.coalesce("question", F.lit(default))})
    names = reports_.select("analysis_id", F.inline("requirements")).select("analysis_id", "requirement", "position", "status", F.col("matched_evidence").alias("evidence"), "confidence")
    return interview_answers(interview_match(asked, names))


def with_reports(history: DataFrame, report_scores: DataFrame) -> DataFrame:
    """History rows beside their report's scores: the table's value first, then the report's,
    then 0. ``has_report`` tells completed reports from missing ones."""
    names = ("overall_score", "coverage_score", "experience_score", "project_score", "quality_score")
    found = report_scores.where("overall_score IS NOT NULL").select(F.col("analysis_id").alias("id"), *(F.col(n).alias(f"r_{n}") for n in names))
    joined = history.join(found, "id", "left")
    return joined.withColumns({"has_report": F.col("r_overall_score").isNotNull(), **{n: F.coalesce(n, f"r_{n}", F.lit(0)) for n in names}}).drop(*(f"r_{n}" for n in names))


def history_detail(analyses: DataFrame, reports_: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Analyses that have a report, with file names that are empty where the file is gone."""
    r = resumes.select(F.col("id").alias("resume_id"), F.col("filename").alias("resume_filename"))
    j = jobs.select(F.col("id").alias("jd_id"), F.col("filename").alias("jd_filename"))
    ids = analyses.select("id", "resume_id", "jd_id", "workflow_status", "created_at")
    out = ids.join(reports_.withColumnRenamed("analysis_id", "id"), "id").join(r, "resume_id", "left").join(j, "jd_id", "left")
    return out.withColumns({n: F.coalesce(n, F.lit("")) for n in ("resume_filename", "jd_filename")})


def requirement_view(rows: DataFrame) -> DataFrame:
    """Verdicts with their ``place`` in the client's order, must before nice, and a flag on skills that are claimed but not shown."""
    flag = F.col("claimed") & ~F.col("demonstrated")
    return ranked(rows.withColumn("over_claimed", flag), ["analysis_id"], [F.when(F.col("importance") == "nice", 1).otherwise(0), F.asc("position"), F.asc("requirement")], "place")


def leaderboard_view(ranking: DataFrame, min_score: int = 0, sort: str = "score") -> DataFrame:
    """The client's filter and order: a floor when above 0; by name, rank or score, ties by rank."""
    rows = ranking.where(F.col("overall_score") >= min_score) if min_score > 0 else ranking
    return rows.orderBy(*{"name": [F.asc("filename")], "rank": []}.get(sort, [F.desc_nulls_last("overall_score")]), F.asc("rank"))


def rendered_evidence(matches: DataFrame, most: int = 3) -> DataFrame:
    """One text per requirement with its ``most`` most confident matches."""
    best = ranked(matches, KEY, [F.desc("confidence"), F.desc("section"), F.desc("chunk")], "r", most)
    line = F.format_string("[%s, %d] %s", "section", "confidence", snippet(F.col("chunk"), 200))
    return best.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))).alias("lines")).select(*KEY, F.array_join("lines.line", "\n").alias("evidence"))
