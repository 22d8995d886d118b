"""Registered queries on reports, changes, interviews, profiles and skills, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import dml, requirements, scoring, search, traits
from ..operators import profile as profile_
from ..settings import WORKFLOW_STATUSES
from ..sources.views import SCORING, Tables, in_list, with_views
from ..streaming import events as events_
from .registry import query

SHORT = r"regexp_replace(trim({x}), '[ \t\n\x0B\f\r]+', ' ', 'g')"
SNIPPET = f"CASE WHEN length({SHORT}) > {{n}} THEN rtrim(left({SHORT}, {{n}})) || '…' ELSE {SHORT} END"


def _verdicts(t: Tables) -> DataFrame:
    return scoring.verdicts(t.requirements, t.matches)


# --- history and reports -----------------------------------------------------

FIVE = ("overall_score", "coverage_score", "experience_score", "project_score", "quality_score")


@query(with_views("analyses", *SCORING) + "SELECT a.id, a.workflow_status, s.analysis_id IS NOT NULL AS has_report, " + ", ".join(f"coalesce(a.{n}, s.{n}, 0) AS {n}" for n in FIVE) + " FROM analyses a LEFT JOIN scored s ON s.analysis_id = a.id")
def history_with_reports(t: Tables) -> DataFrame:
    return scoring.with_reports(t.analyses, scoring.sub_scores(_verdicts(t))).select("id", "workflow_status", "has_report", *FIVE)


@query(with_views("analyses", *SCORING) + """SELECT a.id, a.workflow_status, a.created_at, s.overall_score AS report_score, coalesce(c_name, '') AS resume_filename, coalesce(p_name, '') AS jd_filename
FROM analyses a JOIN scored s ON s.analysis_id = a.id LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = a.resume_id LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = a.jd_id""")
def history_detail(t: Tables) -> DataFrame:
    found = scoring.sub_scores(_verdicts(t)).select("analysis_id", F.col("overall_score").alias("report_score"))
    resumes = t.read("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("filename"))
    jobs = t.read("part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("filename"))
    return scoring.history_detail(t.analyses, found, resumes, jobs).select("id", "workflow_status", "created_at", "report_score", "resume_filename", "jd_filename")


@query(with_views("analyses") + "SELECT id, resume_id, jd_id, overall_score FROM analyses WHERE id = 42")
def analysis_lookup(t: Tables) -> DataFrame:
    return search.lookup(t.analyses, 42).select("id", "resume_id", "jd_id", "overall_score")


@query(with_views(*SCORING) + """SELECT v.analysis_id, upper(v.requirement) AS requirement, coalesce(n.importance, 'must') AS importance, coalesce(n.weight, 1::DOUBLE) AS weight
FROM requirements v LEFT JOIN (SELECT * FROM requirements WHERE importance = 'nice') n ON n.analysis_id = v.analysis_id AND lower(n.requirement) = lower(v.requirement)""")
def evidence_priorities(t: Tables) -> DataFrame:
    listed = t.requirements.where("importance = 'nice'")
    return scoring.with_priorities(t.requirements.select("analysis_id", F.upper("requirement").alias("requirement")), listed)


@query(with_views("analyses", *SCORING) + "SELECT a.id AS analysis_id, 'text of ' || a.id AS summary, s.overall_score, s.matched_count FROM analyses a LEFT JOIN scored s ON s.analysis_id = a.id")
def report_overlay(t: Tables) -> DataFrame:
    fits = t.analyses.select(F.col("id").alias("analysis_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("summary"), F.lit(-1).alias("overall_score"))
    return scoring.overlay(fits, scoring.sub_scores(_verdicts(t)).select("analysis_id", "overall_score", "matched_count"))


RELATIONS = """relations AS (
  SELECT analysis_id, requirement, CASE position % 3 WHEN 0 THEN 'equivalent' WHEN 1 THEN 'related' ELSE 'none' END AS relation, 'near ' || requirement AS related_skill,
         0.60::DOUBLE + (position % 40) / 100.0::DOUBLE AS cosine, position % 2 = 0 AS narrative, 'shown with ' || requirement AS skill_chunk FROM requirements),
rescued AS (
  SELECT v.*, r.relation, r.cosine,
         CASE WHEN v.covered THEN v.status WHEN r.relation = 'equivalent' THEN CASE WHEN r.narrative THEN 'Matched' ELSE 'Partial' END ELSE 'Missing' END AS verdict,
         CASE WHEN v.covered THEN v.confidence WHEN r.relation = 'equivalent' THEN CAST(trunc(r.cosine * 100) AS BIGINT) ELSE 0 END AS sure,
         CASE WHEN v.covered THEN v.evidence WHEN r.relation = 'equivalent' THEN r.skill_chunk ELSE '' END AS shown, v.covered OR r.relation = 'equivalent' AS met
  FROM verdicts v JOIN relations r USING (analysis_id, requirement))
"""


def _rescued(t: Tables) -> DataFrame:
    p = F.col("position")
    relations = t.requirements.select(
        "analysis_id", "requirement", F.when(p % 3 == 0, "equivalent").when(p % 3 == 1, "related").otherwise("none").alias("relation"), F.concat(F.lit("near "), "requirement").alias("related_skill"),
        (F.lit(0.60) + (p % 40) / F.lit(100.0)).alias("cosine"), (p % 2 == 0).alias("narrative"), F.concat(F.lit("shown with "), "requirement").alias("skill_chunk"),
    )
    return scoring.verdicts(t.requirements, t.matches, relations)


@query(with_views(*SCORING) + ", " + RELATIONS + "SELECT analysis_id, requirement, relation, verdict AS status, sure AS confidence, shown AS evidence, met AS covered, demonstrated FROM rescued")
def requirement_rescue(t: Tables) -> DataFrame:
    return _rescued(t).select("analysis_id", "requirement", "relation", "status", "confidence", "evidence", "covered", "demonstrated")


@query(with_views(*SCORING) + ", " + RELATIONS + """SELECT analysis_id, requirement, CASE WHEN verdict = 'Partial' THEN '2-4 days' WHEN relation = 'related' AND cosine >= 0.78 THEN '5-7 days' WHEN relation = 'related' AND cosine >= 0.62 THEN '10-14 days' ELSE '21-28 days' END AS estimated_time FROM rescued WHERE verdict = 'Missing' OR verdict = 'Partial' AND covered""")
def learning_bands(t: Tables) -> DataFrame:
    return scoring.learning_roadmap(_rescued(t)).select("analysis_id", "requirement", "estimated_time")


@query(with_views(*SCORING) + ", " + RELATIONS + f"""SELECT analysis_id, requirement,
  CASE WHEN relation = 'equivalent' AND NOT covered THEN 'near ' || requirement || ' stands in for ' || requirement || ': the two are used alike.' WHEN verdict = 'Matched' THEN 'Shown at work in ' || section || ': "' || ({SNIPPET.format(x='shown', n=90)}) || '".'
       WHEN verdict = 'Partial' THEN requirement || ' is named, but no project shows it at work.' WHEN relation = 'related' THEN 'Not shown; near ' || requirement || ' is close to it.' ELSE 'Not shown, and nothing close to it either.' END AS explanation,
  CASE WHEN verdict = 'Matched' THEN 'None' WHEN verdict = 'Partial' THEN 'How deep ' || requirement || ' goes is open.' ELSE 'A gap.' END AS limitations FROM rescued""")
def explanations(t: Tables) -> DataFrame:
    return scoring.explained(_rescued(t)).select("analysis_id", "requirement", "explanation", "limitations")


@query(with_views(*SCORING) + ", " + RELATIONS + """SELECT analysis_id, string_agg(text, '; ' ORDER BY position, requirement) AS relationships FROM (
  SELECT r.analysis_id, requirement, r.position, CASE WHEN covered AND narrative AND r.relation <> 'none' THEN 'Work with ' || related_skill || ' backs ' || requirement || '.' WHEN NOT covered AND r.relation = 'equivalent' THEN related_skill || ' counts as ' || requirement || '.'
    WHEN NOT covered AND r.relation = 'related' THEN requirement || ' is a short way from ' || related_skill || '.' END AS text
  FROM rescued r JOIN (SELECT analysis_id, requirement, narrative, related_skill FROM relations) q USING (analysis_id, requirement)) WHERE text IS NOT NULL GROUP BY 1""")
def skill_relationships(t: Tables) -> DataFrame:
    return scoring.skill_relationships(_rescued(t)).select("analysis_id", F.array_join("skill_relationships", "; ").alias("relationships"))


@query(with_views(*SCORING) + ", " + RELATIONS + """SELECT a.analysis_id, coalesce(q, 'Walk me through a project you are proud of.; When did you last have to learn a tool quickly?') AS questions FROM (SELECT DISTINCT analysis_id FROM requirements) a LEFT JOIN (
  SELECT analysis_id, string_agg(text, '; ' ORDER BY kind, r) AS q FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY kind, r) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY analysis_id, kind ORDER BY position, requirement) AS r FROM (
      SELECT analysis_id, position, requirement, CASE WHEN verdict = 'Missing' AND relation = 'related' THEN 0 WHEN verdict = 'Partial' THEN 1 WHEN verdict = 'Matched' THEN 2 END AS kind,
        CASE WHEN verdict = 'Missing' THEN 'How would you bring what you know of near ' || requirement || ' to ' || requirement || '?' WHEN verdict = 'Partial' THEN 'Which problem have you solved with ' || requirement || ', and what came of it?' ELSE 'Which hard trade-off have you met in your work with ' || requirement || '?' END AS text FROM rescued)
      WHERE kind IS NOT NULL) WHERE r <= CASE kind WHEN 0 THEN 3 ELSE 2 END) WHERE place <= 5 GROUP BY 1) b USING (analysis_id)""")
def interview_questions(t: Tables) -> DataFrame:
    return scoring.interview_questions(_rescued(t)).select("analysis_id", F.array_join("interview_questions", "; ").alias("questions"))


@query(with_views(*SCORING) + "SELECT analysis_id, requirement, covered AND NOT demonstrated AS over_claimed, row_number() OVER (PARTITION BY analysis_id ORDER BY importance = 'nice', position, requirement) AS place FROM verdicts")
def requirement_view(t: Tables) -> DataFrame:
    return scoring.requirement_view(_verdicts(t)).select("analysis_id", "requirement", "over_claimed", "place")


@query(with_views(*SCORING) + "SELECT analysis_id, coalesce(string_agg(requirement, '; ' ORDER BY requirement) FILTER (covered AND NOT demonstrated), '') AS skills FROM verdicts GROUP BY 1")
def over_claimed_skills(t: Tables) -> DataFrame:
    return scoring.reports(_verdicts(t)).select("analysis_id", F.array_join("authenticity.over_claimed_skills", "; ").alias("skills"))


@query(with_views(*SCORING) + """SELECT analysis_id, overall_score, coverage_score, credibility_score, keyword_stuffing_risk, matched_count, missing_count,
  coalesce((SELECT string_agg(requirement, '; ' ORDER BY position, requirement) FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY position, requirement) AS r FROM verdicts WHERE status = 'Missing') m WHERE m.analysis_id = s.analysis_id AND r <= 5), '') AS top_missing
FROM scored s""")
def ranking_rows(t: Tables) -> DataFrame:
    rows = scoring.ranking_rows(scoring.reports(_verdicts(t)))
    return rows.select("analysis_id", "overall_score", "coverage_score", "credibility_score", "keyword_stuffing_risk", "matched_count", "missing_count", F.array_join("top_missing_skills", "; ").alias("top_missing"))


@query(with_views(*SCORING) + """SELECT analysis_id, CASE WHEN overall_score >= 80 THEN 'success' WHEN overall_score >= 60 THEN 'warning' ELSE 'danger' END AS tone FROM scored""")
def recommendation_tone(t: Tables) -> DataFrame:
    return scoring.sub_scores(_verdicts(t)).select("analysis_id", S.recommendation_tone(F.col("recruiter_recommendation")).alias("tone"))


@query(with_views("analyses") + """, b AS (SELECT c_name AS filename, overall_score, row_number() OVER (PARTITION BY jd_id ORDER BY overall_score DESC, id) AS rank, id FROM analyses JOIN customer ON c_custkey = resume_id WHERE overall_score >= 70)
SELECT id, filename, overall_score, rank FROM b ORDER BY filename, rank, id LIMIT 50""")
def leaderboard_page(t: Tables) -> DataFrame:
    """First page of the leaderboard by name, above a score of 70."""
    rows = t.analyses.where("overall_score IS NOT NULL").join(t.resumes.select(F.col("id").alias("resume_id"), "filename"), "resume_id")
    ranked = scoring.ranked(rows.where("overall_score >= 70"), ["jd_id"], [F.desc("overall_score"), F.asc("id")], "rank")
    view = scoring.leaderboard_view(ranked.withColumn("rank", F.struct("rank", "id")), 70, "name").limit(50)
    return view.select("id", "filename", "overall_score", F.col("rank.rank").alias("rank"))


@query(with_views(*SCORING) + f"""SELECT analysis_id, requirement, string_agg('[' || section || ', ' || conf || '] ' || ({SNIPPET.format(x='chunk', n=200)}), chr(10) ORDER BY n) AS evidence
FROM (SELECT *, confidence AS conf2, row_number() OVER (PARTITION BY analysis_id, requirement ORDER BY confidence DESC NULLS LAST, section DESC, chunk DESC) AS n FROM (SELECT analysis_id, requirement, chunk, section, coalesce(confidence, 0) AS confidence, coalesce(confidence, 0) AS conf FROM evidence WHERE chunk IS NOT NULL)) WHERE n <= 3 GROUP BY ALL""")
def rendered_evidence(t: Tables) -> DataFrame:
    return scoring.rendered_evidence(t.matches.withColumn("confidence", F.coalesce("confidence", F.lit(0))))


# --- interviews --------------------------------------------------------------


@query(with_views(*SCORING) + """, q AS (SELECT analysis_id, position AS question_id, 'How did you use ' || requirement || ' at work?' AS question FROM verdicts WHERE position % 2 = 1),
asked AS (SELECT analysis_id, coalesce(question_id, 0) AS question_id, coalesce(question, 'Walk me through a project you are proud of.') AS question FROM (SELECT DISTINCT analysis_id FROM verdicts) LEFT JOIN q USING (analysis_id)),
hit AS (SELECT a.analysis_id, a.question_id, v.requirement, v.status, v.evidence, v.confidence, row_number() OVER (PARTITION BY a.analysis_id, a.question_id ORDER BY length(v.requirement) DESC, v.position) AS r FROM asked a JOIN verdicts v USING (analysis_id) WHERE contains(lower(a.question), lower(v.requirement))),
m AS (SELECT a.*, requirement, coalesce(status, 'Missing') AS status, coalesce(evidence, '') AS evidence, coalesce(confidence, 0) AS confidence, coalesce(requirement, 'this area') AS name FROM asked a LEFT JOIN (SELECT * FROM hit WHERE r = 1) USING (analysis_id, question_id))
SELECT analysis_id, question_id, question, confidence, CASE WHEN status = 'Matched' AND evidence <> '' THEN 'backed' WHEN status = 'Partial' THEN 'shallow' ELSE 'gap' END AS verdict,
  CASE WHEN status = 'Matched' AND evidence <> '' THEN 'Points to work with ' || name || ': "' || evidence || '".' WHEN status = 'Partial' THEN 'Names ' || name || ' without depth.' ELSE 'Has no evidence of ' || name || ' to draw on.' END AS ideal_answer,
  CASE WHEN confidence < 60 THEN 'Which measurable result did your work with ' || name || ' have?' ELSE '' END AS follow_up FROM m""")
def interview_answers(t: Tables) -> DataFrame:
    rows = _verdicts(t)
    asked = rows.where("position % 2 = 1").select("analysis_id", F.col("position").alias("question_id"), F.concat(F.lit("How did you use "), "requirement", F.lit(" at work?")).alias("question"))
    found = scoring.interview(scoring.reports(rows), asked)
    return found.select("analysis_id", "question_id", "question", "confidence", "verdict", "ideal_answer", F.array_join("follow_up_questions", " ").alias("follow_up"))


# --- changes -----------------------------------------------------------------

STATUS = "CASE l_returnflag WHEN 'A' THEN 'Technical' WHEN 'R' THEN 'Offer' ELSE 'No such status' END"


@query(with_views("analyses") + f""", c AS (SELECT l_orderkey AS id, max_by({STATUS}, (l_linenumber * 1000000 + l_partkey) * 256 + ascii(l_returnflag)) AS new_status FROM lineitem WHERE {STATUS} IN ({in_list(WORKFLOW_STATUSES)}) GROUP BY 1)
SELECT a.id, coalesce(c.new_status, a.workflow_status) AS workflow_status FROM analyses a LEFT JOIN c USING (id)""")
def status_update(t: Tables) -> DataFrame:
    changes = t.read("lineitem").select(F.col("l_orderkey").alias("id"), F.expr(STATUS).alias("workflow_status"), F.expr("(l_linenumber * 1000000 + l_partkey) * 256 + ascii(l_returnflag)").alias("seq"))
    return dml.update_status(t.analyses, changes).select("id", "workflow_status")


@query("SELECT conv_id AS analysis_id, turn FROM conversations WHERE length(trim(text)) BETWEEN 1 AND 5000 AND length(trim(role)) BETWEEN 1 AND 255 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = conv_id AND o_orderstatus <> 'P')")
def valid_notes(t: Tables) -> DataFrame:
    notes = t.read("conversations").select(F.col("conv_id").alias("analysis_id"), "turn", "text", F.col("role").alias("author"))
    return dml.valid_notes(notes, t.analyses.where("overall_score IS NOT NULL")).select("analysis_id", "turn")


@query("SELECT event_id AS id, ts AS created_at, event_type AS author FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def newest_notes(t: Tables) -> DataFrame:
    """The first page of notes, newest first."""
    notes = t.read("events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("author"))
    return dml.newest_notes(notes).limit(25)


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_texts(t: Tables) -> DataFrame:
    return dml.first_occurrences(t.read("documents"), ["text"], "doc_id").select("doc_id", "source")


@query("SELECT l_partkey AS part, min(l_orderkey) AS position FROM lineitem GROUP BY 1")
def ids_in_order(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("position"))
    return dml.dedupe_in_order(rows, "part", "position")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def stale_sources(t: Tables) -> DataFrame:
    """Every third text has changed since it was indexed, every fifth was indexed without a fingerprint."""
    docs = t.read("documents")
    sha = lambda x: S.fingerprint(x).alias("sha")
    current = docs.select(F.col("doc_id").alias("resume_id"), sha(F.col("text")))
    old = docs.select(F.col("doc_id").alias("resume_id"), F.when(F.col("doc_id") % 5 != 0, sha(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "!").otherwise("")))).alias("sha"))
    return dml.stale_sources(current, old).select(F.col("resume_id").alias("doc_id"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS count FROM events GROUP BY ALL")
def events_daily(t: Tables) -> DataFrame:
    """The streaming form on a bounded table."""
    return events_.daily_counts(t.read("events"))


# --- skills and profiles -----------------------------------------------------


@query(with_views("evidence") + """SELECT analysis_id, skill, narrative, section FROM (
  SELECT analysis_id, lower(requirement) AS skill, section IN ('Experience', 'Projects') AS narrative, section, row_number() OVER (PARTITION BY analysis_id, lower(requirement) ORDER BY section IN ('Experience', 'Projects') DESC, p_partkey, l.section) AS r FROM evidence l WHERE chunk IS NOT NULL) WHERE r = 1""")
def candidate_skills(t: Tables) -> DataFrame:
    rows = t.evidence.where("chunk IS NOT NULL").select("analysis_id", F.struct("p_partkey", "section").alias("position"), F.concat(F.lit("works with "), "requirement").alias("chunk"), "section")
    return requirements.candidate_skills(rows).select("analysis_id", "skill", "narrative", "section")


PEOPLE = """people AS (SELECT c_custkey AS id, ['', '--- PAGE 1 ---',
  CASE c_custkey % 5 WHEN 0 THEN 'Jane ' || initcap_(c_mktsegment) WHEN 1 THEN 'jane@example.org' WHEN 2 THEN 'Lead Engineer' WHEN 3 THEN '12 Main Street' ELSE 'A Line Of Far Too Many Words' END,
  CASE c_custkey % 3 WHEN 0 THEN 'O''Neil Mary-Ann' WHEN 1 THEN 'see http' ELSE 'Senior ' || lower(c_mktsegment) || ' Developer' END, '  ',
  CASE c_custkey % 2 WHEN 0 THEN 'Data Analyst' ELSE 'one two three four five six analyst' END, 'More than 12 years', 'and 7.5+ years', 'Project Manager'] AS lines FROM customer)""".replace("initcap_(c_mktsegment)", "c_mktsegment")
ROLES = profile_.ROLE.removeprefix("(?i)")


@query(f"""WITH {PEOPLE}, kept AS (SELECT id, list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> '' AND NOT x LIKE '---%')[1:8] AS l FROM people)
SELECT id, list_filter(l[1:3], lambda x: NOT regexp_matches(x, '@|[0-9]|(?i:http)') AND len(string_split(x, ' ')) <= 4 AND regexp_matches(x, '^[A-Za-z.''’ -]+$') AND NOT regexp_matches(x, '(?i){ROLES}'))[1] AS name,
  list_filter(l[1:6], lambda x: regexp_matches(x, '(?i){ROLES}') AND len(string_split(x, ' ')) <= 6)[1] AS title, 12::DOUBLE AS total_years, 'Lead' AS seniority_level FROM kept""")
def identity(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    one = F.when(c % 5 == 0, F.concat(F.lit("Jane "), "c_mktsegment")).when(c % 5 == 1, "jane@example.org").when(c % 5 == 2, "Lead Engineer").when(c % 5 == 3, "12 Main Street").otherwise("A Line Of Far Too Many Words")
    two = F.when(c % 3 == 0, "O'Neil Mary-Ann").when(c % 3 == 1, "see http").otherwise(F.concat(F.lit("Senior "), F.lower("c_mktsegment"), F.lit(" Developer")))
    three = F.when(c % 2 == 0, "Data Analyst").otherwise("one two three four five six analyst")
    lines = F.array(F.lit(""), F.lit("--- PAGE 1 ---"), one, two, F.lit("  "), three, F.lit("More than 12 years"), F.lit("and 7.5+ years"), F.lit("Project Manager"))
    rows = t.read("customer").select(c.alias("id"), F.array_join(lines, "\n").alias("resume_text"), F.lit("").alias("jd_text"))
    return profile_.profiles(rows).select("id", "name", "title", "total_years", "seniority_level")


@query()
def trait_model(t: Tables) -> DataFrame:
    """TF-IDF and the five regressions fitted to four fifths of the documents, on all of them."""
    shares = [F.expr(f"(n_chars % {k}) / {k}.0D").alias(n) for n, k in zip(traits.TRAITS, (7, 11, 13, 17, 19))]
    rows = t.read("documents").select("doc_id", F.col("text").alias("Resume_Text"), *shares)
    learn, _ = traits.split(rows, "doc_id")
    return traits.train(learn).transform(rows).select("doc_id", *(f"{n.lower()}_score" for n in traits.TRAITS))
