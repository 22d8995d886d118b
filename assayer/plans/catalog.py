"""Every registered query with its SQL form, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.vectors import dot
from ..operators import analytics, dml, requirements, retrieval, scoring, search, structuring
from ..operators import profile as profile_
from ..settings import DEFAULTS
from ..sources import files
from ..sources.shared import materialise
from ..sources.views import SCORING, TEXTS, WS, Tables, in_list, with_views
from . import pipeline_catalog, report_catalog, store_catalog  # noqa: F401  (register their queries)
from .registry import REGISTRY, query

#: The default thresholds are calibrated for one text encoder; these suit the tables' own vectors.
VECTORS = replace(DEFAULTS, similarity_floor=0.15, category_floor=0.2, equivalent_min=0.3, related_min=0.2)
TOKENS = "regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+#./-]*')"
LABEL = "CASE WHEN overall_score >= 80 THEN 'Selected' WHEN overall_score >= 60 THEN 'Borderline' ELSE 'Rejected' END"
WORKFLOW = "CASE WHEN workflow_status IS NULL OR workflow_status = '' THEN 'Applied' ELSE workflow_status END"


def half_up(x: str, places: int = 2) -> str:
    return f"floor(({x}) * {10**places}::DOUBLE + 0.5::DOUBLE) / {10**places}::DOUBLE"


AVERAGES = ", ".join(f"coalesce({half_up(f'avg({n}_score)')}, 0::DOUBLE) AS average_{n}" for n in analytics.SUB_SCORES)
COUNTS = "count(*) FILTER (overall_score >= 80) AS selected, count(*) FILTER (overall_score >= 60 AND overall_score < 80) AS borderline, count(*) FILTER (overall_score < 60) AS rejected"


@query(with_views("bulk") + f"SELECT count(*) AS total, {AVERAGES}, {COUNTS} FROM bulk WHERE overall_score IS NOT NULL")
def overall_statistics(t: Tables) -> DataFrame:
    return analytics.overall_statistics(t.bulk)


@query(with_views("analyses") + f"SELECT {COUNTS} FROM analyses WHERE overall_score IS NOT NULL")
def recommendation_counts(t: Tables) -> DataFrame:
    return analytics.recommendation_counts(t.analyses)


@query(with_views("analyses") + f""", c AS (SELECT {COUNTS}, count(*) AS n FROM analyses WHERE overall_score IS NOT NULL)
SELECT recommendation, count, coalesce({half_up('count / nullif(n, 0)::DOUBLE * 100')}, 0) AS percentage FROM (
  SELECT 'Selected' AS recommendation, selected AS count, n FROM c UNION ALL SELECT 'Borderline', borderline, n FROM c UNION ALL SELECT 'Rejected', rejected, n FROM c)""")
def recommendation_distribution(t: Tables) -> DataFrame:
    return analytics.recommendation_distribution(t.analyses)


DISTRIBUTION = """, bands(label, min_score, max_score) AS (VALUES ('0-20', 0::BIGINT, 20::BIGINT), ('21-40', 21, 40), ('41-60', 41, 60), ('61-80', 61, 80), ('81-100', 81, 100)),
d AS (SELECT label, min_score, max_score, count(overall_score) AS count FROM bands LEFT JOIN bulk ON overall_score BETWEEN min_score AND max_score GROUP BY ALL)
"""


@query(with_views("bulk") + DISTRIBUTION + "SELECT *, CAST(sum(count) OVER () AS BIGINT) AS total FROM d")
def score_distribution(t: Tables) -> DataFrame:
    return analytics.score_distribution(t.bulk)


@query(with_views("bulk") + DISTRIBUTION + "SELECT label, count FROM d")
def dashboard_distribution(t: Tables) -> DataFrame:
    return analytics.score_distribution(t.bulk).select("label", "count")


PERIODS = {"daily": "strftime(created_at, '%Y-%m-%d')", "weekly": "strftime(created_at, '%Y-W%W')", "monthly": "strftime(created_at, '%Y-%m')"}
SINCE = {
    "daily": "(SELECT date_trunc('day', max(created_at)) - INTERVAL 29 DAY FROM {v})",
    "weekly": "(SELECT max(created_at) - INTERVAL 84 DAY FROM {v})",
    "monthly": "(SELECT max(created_at) - INTERVAL 372 DAY FROM {v})",
}


def _trend_sql(grain: str, view: str) -> str:
    return f"SELECT {PERIODS[grain]} AS period, count(*) AS count FROM {view} WHERE overall_score IS NOT NULL AND created_at >= {SINCE[grain].format(v=view)} GROUP BY 1"


for _grain in PERIODS:
    query(with_views("bulk") + _trend_sql(_grain, "bulk"), f"{_grain}_trend")(lambda t, g=_grain: analytics.trend(t.bulk, g))


@query(with_views("analyses") + " UNION ALL ".join(f"SELECT '{g}' AS grain, * FROM ({_trend_sql(g, 'analyses')})" for g in PERIODS))
def trend_bundle(t: Tables) -> DataFrame:
    return analytics.trend_bundle(t.analyses)


@query(with_views("analyses") + f""", d AS ({_trend_sql('daily', 'analyses')}), e AS (SELECT max(created_at)::DATE AS last FROM analyses)
SELECT strftime(day, '%Y-%m-%d') AS period, coalesce(count, 0) AS count FROM (SELECT unnest(generate_series(last - INTERVAL 29 DAY, last, INTERVAL 1 DAY)) AS day FROM e) LEFT JOIN d ON d.period = strftime(day, '%Y-%m-%d')""")
def daily_trend_zero_filled(t: Tables) -> DataFrame:
    return analytics.daily_trend_zero_filled(t.analyses)


@query(with_views("analyses") + "SELECT c_name AS filename, count(*) AS count FROM analyses JOIN customer ON resume_id = c_custkey WHERE overall_score IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_resumes(t: Tables) -> DataFrame:
    return analytics.top_by_filename(t.analyses, t.resumes, "resume_id")


@query(with_views("analyses") + "SELECT p_name AS filename, count(*) AS count FROM analyses JOIN part ON jd_id = p_partkey WHERE overall_score IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_jobs(t: Tables) -> DataFrame:
    return analytics.top_by_filename(t.analyses, t.jobs, "jd_id")


HISTORY = f"id, resume_filename, jd_filename, overall_score, {LABEL} AS recommendation, {WORKFLOW} AS workflow_status, created_at"


@query(with_views("analyses", "star") + f"SELECT {HISTORY} FROM star ORDER BY created_at DESC, id DESC LIMIT 10")
def recent_activity(t: Tables) -> DataFrame:
    return analytics.recent_activity(t.analyses, t.resumes, t.jobs)


FILTER = search.HistoryFilter(resume_filename="customer#%1", recommendation="Selected", min_score=81, max_score=99, date_from=date(1996, 1, 1), date_to=date(2000, 6, 30), sort="highest_score", page=2, page_size=10)
FILTER_SQL = "lower(resume_filename) LIKE '%customer#%1%' AND overall_score >= 80 AND overall_score >= 81 AND overall_score <= 99 AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2000-07-01'"


@query(with_views("analyses", "star") + f"SELECT {HISTORY} FROM star WHERE {FILTER_SQL} ORDER BY star.overall_score DESC, id DESC LIMIT 10 OFFSET 10")
def history_page(t: Tables) -> DataFrame:
    return search.page(t.analyses, t.resumes, t.jobs, FILTER)


@query(with_views("analyses", "star") + f"SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM star WHERE {FILTER_SQL}")
def history_count(t: Tables) -> DataFrame:
    return search.totals(t.analyses, t.resumes, t.jobs, FILTER)


@query(with_views("analyses", "star") + f"SELECT id, resume_filename, jd_filename, overall_score, {LABEL} AS recommendation FROM star WHERE lower(jd_filename) LIKE '%e%'")
def history_search(t: Tables) -> DataFrame:
    rows = search.matching(t.analyses, t.resumes, t.jobs, search.HistoryFilter(jd_filename="E"))
    return rows.select("id", "resume_filename", "jd_filename", "overall_score", S.recommendation(F.col("overall_score")).alias("recommendation"))


@query(with_views("analyses", "star") + "SELECT id, overall_score FROM star ORDER BY overall_score, id LIMIT 20")
def history_lowest(t: Tables) -> DataFrame:
    return search.page(t.analyses, t.resumes, t.jobs, search.HistoryFilter(sort="lowest_score")).select("id", "overall_score")


@query(with_views("analyses") + f"SELECT count(*) AS total_candidates, coalesce({half_up('avg(overall_score)')}, 0) AS average_overall, coalesce({half_up('avg(coverage_score)')}, 0) AS average_skill_score, coalesce({half_up('avg(experience_score)')}, 0) AS average_experience_score, {COUNTS} FROM analyses WHERE overall_score IS NOT NULL")
def dashboard_overview(t: Tables) -> DataFrame:
    return analytics.dashboard_overview(t.analyses)


@query(with_views("bulk") + DISTRIBUTION + f", c AS (SELECT {COUNTS}, count(*) AS n FROM bulk WHERE overall_score IS NOT NULL) SELECT max(greatest(1, count)) AS max_count, CAST(floor(any_value(selected) / any_value(n)::DOUBLE * 100 + 0.5) AS BIGINT) AS selected_share, CAST(floor(any_value(rejected) / any_value(n)::DOUBLE * 100 + 0.5) AS BIGINT) AS rejected_share FROM d, c")
def chart_maxima(t: Tables) -> DataFrame:
    return analytics.chart_maxima(t.bulk)


@query(with_views("analyses") + f"SELECT id, {LABEL} AS recommendation, CASE WHEN overall_score >= 75 THEN 'Selected' WHEN overall_score >= 60 THEN 'Borderline' WHEN overall_score IS NOT NULL THEN 'Rejected' END AS fit, CASE WHEN overall_score >= 75 THEN 'Low' WHEN overall_score >= 60 THEN 'Medium' WHEN overall_score IS NOT NULL THEN 'High' END AS risk, CAST(least(5, greatest(0, floor(overall_score / 20.0::DOUBLE + 0.5::DOUBLE))) AS BIGINT) AS stars, CASE WHEN overall_score >= 80 THEN 'Highly Recommended - Proceed to Technical Screen' WHEN overall_score >= 60 THEN 'Conditional Match - Proceed to Initial Interview' WHEN overall_score IS NOT NULL THEN 'Not Recommended - Reject' END AS wording FROM analyses")
def score_labels(t: Tables) -> DataFrame:
    x = F.col("overall_score")
    return t.analyses.select("id", S.recommendation(x).alias("recommendation"), S.fit_category(x).alias("fit"), S.hiring_risk(x).alias("risk"), F.when(x.isNotNull(), S.star_rating(x)).otherwise(F.lit(0)).alias("stars"), S.recommendation_text(x).alias("wording"))


# --- scoring ---------------------------------------------------------------


@query(with_views(*SCORING) + "SELECT analysis_id, requirement, importance, weight, status, confidence, section, evidence, covered, demonstrated FROM verdicts")
def requirement_verdict(t: Tables) -> DataFrame:
    return scoring.verdicts(t.requirements, t.matches).select("analysis_id", "requirement", "importance", "weight", "status", "confidence", "section", "evidence", "covered", "demonstrated")


@query(with_views(*SCORING) + "SELECT analysis_id, coverage_score FROM scored")
def weighted_coverage(t: Tables) -> DataFrame:
    return scoring.weighted_coverage(scoring.verdicts(t.requirements, t.matches))


@query(with_views(*SCORING) + "SELECT analysis_id, claimed, demonstrated, corroboration_ratio, credibility_score, keyword_stuffing_risk, quality_score FROM authentic")
def authenticity(t: Tables) -> DataFrame:
    return scoring.authenticity(scoring.verdicts(t.requirements, t.matches))


SCORE_COLUMNS = "analysis_id, overall_score, coverage_score, experience_score, project_score, confidence_score, quality_score, matched_count, partial_count, missing_count"


@query(with_views(*SCORING) + f"SELECT {SCORE_COLUMNS} FROM scored")
def overall_score(t: Tables) -> DataFrame:
    return scoring.sub_scores(scoring.verdicts(t.requirements, t.matches)).select(*SCORE_COLUMNS.split(", "))


@query(with_views(*SCORING) + "SELECT analysis_id, sum(CASE WHEN status = 'Matched' THEN 1 ELSE 0 END)::BIGINT AS matched, sum(CASE WHEN status = 'Partial' THEN 1 ELSE 0 END)::BIGINT AS partial, sum(CASE WHEN status = 'Missing' THEN 1 ELSE 0 END)::BIGINT AS missing FROM verdicts GROUP BY 1")
def status_counts(t: Tables) -> DataFrame:
    return scoring.status_counts(scoring.reports(scoring.verdicts(t.requirements, t.matches)))


@query(with_views(*SCORING) + """, k AS (SELECT CASE status WHEN 'Missing' THEN 'missing' ELSE 'matched' END AS kind, requirement AS skill, count(*) AS count FROM verdicts WHERE status <> 'Partial' GROUP BY ALL)
SELECT kind, skill, count FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, skill) AS r FROM k) WHERE r <= 5""")
def skill_frequency(t: Tables) -> DataFrame:
    return analytics.verdict_frequency(scoring.verdicts(t.requirements, t.matches))


@query(with_views(*SCORING) + "SELECT analysis_id, requirement, CASE WHEN status = 'Partial' THEN '2-4 days' ELSE '21-28 days' END AS estimated_time FROM verdicts WHERE status <> 'Matched'")
def learning_roadmap(t: Tables) -> DataFrame:
    return scoring.learning_roadmap(scoring.verdicts(t.requirements, t.matches)).select("analysis_id", "requirement", "estimated_time")


@query(with_views(*SCORING) + """, w AS (SELECT analysis_id, CASE WHEN status = 'Missing' AND importance = 'must' THEN 0 ELSE 1 END AS k, CASE WHEN status = 'Missing' AND importance = 'must' THEN -position ELSE position END AS p,
  CASE WHEN status = 'Missing' AND importance = 'must' THEN 'Missing must-have: ' || requirement WHEN status = 'Missing' THEN 'Missing nice-to-have: ' || requirement ELSE requirement || ': named, not backed by project work' END AS text FROM verdicts WHERE status <> 'Matched')
SELECT analysis_id, string_agg(text, '; ' ORDER BY k, p, text) AS weaknesses FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY k, p, text) AS r FROM w) WHERE r <= 5 GROUP BY 1""")
def weaknesses(t: Tables) -> DataFrame:
    return scoring.weaknesses(scoring.verdicts(t.requirements, t.matches)).select("analysis_id", F.array_join("weaknesses", "; ").alias("weaknesses"))


RANKED = """, e AS (SELECT jd_id, resume_id, min_by(overall_score, id) AS overall_score, min(id) AS position, CASE WHEN min_by(overall_score, id) IS NULL THEN 'not scored' END AS error FROM analyses GROUP BY ALL)
, l AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY error IS NOT NULL, overall_score DESC NULLS LAST, position) AS rank FROM e)
"""


def _entries(t: Tables) -> DataFrame:
    return t.analyses.select("jd_id", "resume_id", F.col("id").alias("position"), "overall_score", F.when(F.col("overall_score").isNull(), "not scored").alias("error"))


@query((with_views("analyses") + RANKED).replace("min_by(overall_score, id)", "arg_min_null(overall_score, id)") + "SELECT jd_id, resume_id, position, overall_score, error, rank FROM l")
def leaderboard(t: Tables) -> DataFrame:
    return scoring.leaderboard(_entries(t)).select("jd_id", "resume_id", "position", "overall_score", "error", "rank")


@query((with_views("analyses") + RANKED).replace("min_by(overall_score, id)", "arg_min_null(overall_score, id)") + "SELECT jd_id, count(*) AS candidates, count(*) FILTER (error IS NULL) AS evaluated FROM l GROUP BY 1")
def ranking_summary(t: Tables) -> DataFrame:
    return scoring.ranking_summary(scoring.leaderboard(_entries(t)))


@query(with_views("analyses", *SCORING) + "SELECT id, coalesce(a.overall_score, s.overall_score) AS overall_score FROM analyses a LEFT JOIN scored s ON s.analysis_id = a.id")
def score_backfill(t: Tables) -> DataFrame:
    computed = scoring.sub_scores(scoring.verdicts(t.requirements, t.matches)).select(F.col("analysis_id").alias("id"), F.col("overall_score").alias("report_score"))
    return scoring.score_backfill(t.analyses, computed).select("id", "overall_score")


@query(with_views("evidence") + """SELECT analysis_id, requirement, chunk, section, least(100, greatest(0, CAST(trunc(least(100::DOUBLE, greatest(0::DOUBLE, score * 100::DOUBLE)) * 0.7::DOUBLE + (CASE section WHEN 'Experience' THEN 100 WHEN 'Projects' THEN 80 WHEN 'Skills' THEN 30 ELSE 0 END) * 0.15::DOUBLE
  + (CASE WHEN length(chunk) > 150 THEN 100 WHEN length(chunk) > 70 THEN 70 WHEN length(chunk) > 30 THEN 30 ELSE 0 END) * 0.05::DOUBLE + 0 * 0.1::DOUBLE) AS BIGINT))) AS confidence FROM evidence WHERE chunk IS NOT NULL""")
def confidence_blend(t: Tables) -> DataFrame:
    blend = S.confidence(F.col("score"), S.section_score(F.col("section")), S.density_score(F.col("chunk")), F.lit(0))
    return t.matches.select("analysis_id", "requirement", "chunk", "section", blend.alias("confidence"))


@query(with_views("analyses") + "SELECT o.id, CASE WHEN c.c_custkey IS NULL THEN 'resume not found' END AS error, c.c_name AS filename FROM (SELECT id, resume_id FROM analyses) o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.resume_id = c.c_custkey")
def ranking_request(t: Tables) -> DataFrame:
    known = t.read("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("filename"))
    return scoring.requested(t.analyses.select(F.col("id").alias("position"), "resume_id", "jd_id"), known).select(F.col("position").alias("id"), "error", "filename")


# --- retrieval -------------------------------------------------------------

CENTROIDS = """parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM parts GROUP BY ALL) GROUP BY 1),
centroids AS (SELECT label AS category, list_transform(v, lambda y: y / (sqrt(list_dot_product(v, v)) + 1e-9)) AS centroid FROM means)"""


def _centroid_queries(t: Tables) -> DataFrame:
    return retrieval.centroids(t.read("embeddings")).select(F.col("category").cast("long").alias("query_id"), F.col("centroid").alias("query"))


@query(f"WITH {CENTROIDS} SELECT category::BIGINT AS category, i::BIGINT AS pos, round(centroid[i], 6) AS x FROM centroids, generate_series(1, 64) g(i)")
def category_centroid(t: Tables) -> DataFrame:
    return retrieval.centroids(t.read("embeddings")).select(F.col("category").cast("long").alias("category"), F.posexplode("centroid").alias("pos", "x")).select("category", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


TOPK = f"""WITH {CENTROIDS}, scored AS (SELECT category::BIGINT AS query_id, vec_id, list_dot_product(centroid, embedding::DOUBLE[]) AS score FROM embeddings, centroids),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
"""


@query(TOPK + "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= 12")
def vector_topk(t: Tables) -> DataFrame:
    return retrieval.vector_topk(_centroid_queries(t), t.read("embeddings"), 12).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(TOPK + f"SELECT query_id, vec_id FROM ranked WHERE {half_up('score', 3)} >= 0.15")
def similarity_floor(t: Tables) -> DataFrame:
    rows = t.read("embeddings")
    scored = retrieval.with_queries(rows, _centroid_queries(t)).select("query_id", "vec_id", dot(F.col("query"), F.col("embedding")).alias("score"))
    return scored.where(S.round_half_up(F.col("score"), 3) >= VECTORS.similarity_floor).select("query_id", "vec_id")


@query(f"""WITH {CENTROIDS}, scored AS (SELECT vec_id, category::VARCHAR AS category, list_dot_product(centroid, embedding::DOUBLE[]) AS cosine FROM embeddings, centroids),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, category DESC) AS r FROM scored)
SELECT vec_id, CASE WHEN cosine >= 0.2 THEN category ELSE 'General Technical Skill' END AS category, round(cosine, 6) AS cosine FROM best WHERE r = 1""")
def category_classify(t: Tables) -> DataFrame:
    rows = t.read("embeddings")
    return retrieval.classify(rows, retrieval.centroids(rows), VECTORS).withColumn("cosine", F.round("cosine", 6))


RELATED = f"""WITH {CENTROIDS}, r AS (SELECT vec_id AS owner, vec_id::VARCHAR AS name, label AS category, embedding::DOUBLE[] AS vector FROM embeddings),
k AS (SELECT r.owner, r.name, c.category::VARCHAR AS skill, r.category = c.category AS same, list_dot_product(r.vector, c.centroid) AS cosine FROM r, centroids c WHERE r.name <> c.category::VARCHAR),
b AS (SELECT owner, name, max(cosine) AS any_cosine, max(cosine) FILTER (same) AS near_cosine FROM k GROUP BY ALL)
"""


def _skills(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.read("embeddings")
    named = rows.select(F.col("vec_id").alias("owner"), F.col("vec_id").cast("string").alias("name"), F.col("label").alias("category"), F.col("embedding").alias("vector"))
    packed = retrieval.centroids(rows).select(F.col("category").alias("c"), "centroid")
    skills = retrieval.with_queries(named.select("owner"), packed).select("owner", F.col("c").cast("string").alias("name"), F.col("c").alias("category"), F.col("centroid").alias("vector"))
    return named, skills


@query(RELATED + "SELECT owner, CASE WHEN any_cosine >= 0.3 THEN 'equivalent' WHEN near_cosine >= 0.2 THEN 'related' ELSE 'none' END AS relation FROM b")
def related_skill(t: Tables) -> DataFrame:
    return retrieval.related_skills(*_skills(t), VECTORS).select("owner", "relation")


@query(RELATED + "SELECT name, round(least(1, max(cosine + CASE WHEN same THEN 0.1::DOUBLE ELSE 0 END)), 6) AS transfer FROM k GROUP BY 1")
def transfer_score(t: Tables) -> DataFrame:
    named, skills = _skills(t)
    k = skills.select("owner", F.col("name").alias("skill"), F.col("category").alias("c"), F.col("vector").alias("v"))
    pairs = named.join(k, "owner").where("name <> skill").select("name", dot(F.col("vector"), F.col("v")).alias("cosine"), (F.col("category") == F.col("c")).alias("same"))
    return retrieval.transfer_scores(pairs).select("name", F.round("transfer", 6).alias("transfer"))


TERMS = f"""terms AS (SELECT doc_id, len(t) AS doc_len, unnest(t) AS term FROM (SELECT doc_id, {TOKENS} AS t FROM documents)),
counts AS (SELECT doc_id, doc_len, term, count(*) AS tf FROM terms GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len({TOKENS})) AS avg_len FROM documents)"""
BM25 = f"""WITH {TERMS}, asked AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY 1),
bm AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))) AS score
  FROM asked JOIN counts USING (term) JOIN df USING (term), size GROUP BY ALL)
"""


@query(f"WITH {TERMS} SELECT term, count(*) AS df FROM counts GROUP BY 1")
def doc_frequency(t: Tables) -> DataFrame:
    return retrieval.doc_frequency(retrieval.term_counts(t.read("documents")))


@query(BM25 + "SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def bm25_scores(t: Tables) -> DataFrame:
    asked = t.read("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(asked, t.read("documents")).select("query_id", "doc_id", F.round("score", 6).alias("score"))


FUSED = TOPK.replace("WITH ", "", 1)


@query(BM25 + ", " + FUSED + """, c AS (SELECT r.query_id, vec_id AS item_id, rank AS position, round(r.score, 6) AS dense, round(coalesce(bm.score, 0), 6) AS sparse FROM ranked r LEFT JOIN bm ON bm.query_id = r.query_id AND bm.doc_id = r.vec_id WHERE rank <= 40),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, position) - 1 AS dr, row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, position) - 1 AS sr FROM c),
f AS (SELECT *, 0.6::DOUBLE / (60 + dr) + 0.4::DOUBLE / (60 + sr) AS fused FROM o)
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, position) AS rank, round(fused, 9) AS fused FROM f""")
def rrf_fusion(t: Tables) -> DataFrame:
    dense = materialise(retrieval.vector_topk(_centroid_queries(t), t.read("embeddings"), 40), "dense")
    asked = t.read("benchmark").select(F.col("item_id").alias("query_id"), "text")
    sparse = retrieval.bm25(asked, t.read("documents"), only=dense.select(F.col("vec_id").alias("doc_id"))).select("query_id", F.col("doc_id").alias("vec_id"), F.col("score").alias("sparse"))
    both = dense.join(sparse, ["query_id", "vec_id"], "left").select("query_id", F.col("vec_id").alias("item_id"), F.col("rank").alias("position"), F.round("score", 6).alias("dense"), F.round(F.coalesce("sparse", F.lit(0.0)), 6).alias("sparse"))
    return retrieval.fuse(both).select("query_id", "item_id", "rank", F.round("fused", 9).alias("fused"))


HYBRID = f"""{CENTROIDS},
cut AS (SELECT doc_id AS chunk_id, text, CASE WHEN label < 3 THEN 'Experience' WHEN label < 6 THEN 'Projects' ELSE 'Skills' END AS section, embedding FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
pool AS (SELECT * FROM (SELECT item_id AS query_id, chunk_id, list_dot_product(centroid, embedding::DOUBLE[]) AS raw, row_number() OVER (PARTITION BY item_id ORDER BY list_dot_product(centroid, embedding::DOUBLE[]) DESC, chunk_id) AS position
  FROM cut, benchmark JOIN centroids ON category = item_id % 10) WHERE position <= 12),
once AS (SELECT * FROM (SELECT p.*, c.text, c.section, {half_up('raw', 3)} AS cosine, row_number() OVER (PARTITION BY query_id, c.text ORDER BY position) AS copy FROM pool p JOIN cut c USING (chunk_id)) WHERE copy = 1 AND cosine >= 0.15),
kept AS (SELECT o.*, coalesce(bm.score, 0) AS sparse, least(100, greatest(0, CAST(trunc(least(100::DOUBLE, greatest(0::DOUBLE, raw * 100::DOUBLE)) * 0.7::DOUBLE + (CASE section WHEN 'Experience' THEN 100 WHEN 'Projects' THEN 80 ELSE 30 END) * 0.15::DOUBLE
  + (CASE WHEN length(trim(text)) > 150 THEN 100 WHEN length(trim(text)) > 70 THEN 70 WHEN length(trim(text)) > 30 THEN 30 ELSE 0 END) * 0.05::DOUBLE + 0 * 0.1::DOUBLE) AS BIGINT))) AS confidence
  FROM once o LEFT JOIN bm ON bm.query_id = o.query_id AND bm.doc_id = o.chunk_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, position) - 1 AS dr, row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, position) - 1 AS sr FROM kept),
fused AS (SELECT *, 0.6::DOUBLE / (60 + dr) + 0.4::DOUBLE / (60 + sr) AS fused FROM placed)
"""


@query(BM25 + ", " + HYBRID + "SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, position) AS rank, chunk_id AS item_id, section, cosine, confidence, round(sparse, 6) AS sparse, round(fused, 9) AS fused FROM fused) WHERE rank <= 3")
def hybrid_retrieval(t: Tables) -> DataFrame:
    """The whole chain: every document is a chunk that carries a vector, every benchmark item a query."""
    vectors = t.read("embeddings")
    n = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    section = F.when(F.col("label") < 3, "Experience").when(F.col("label") < 6, "Projects").otherwise("Skills")
    chunks = t.read("documents").withColumn("vec_id", F.pmod("doc_id", n)).join(vectors, "vec_id").select(F.col("doc_id").alias("chunk_id"), "text", section.alias("section"), F.lit(0).alias("technical"), "embedding")
    items = t.read("benchmark").withColumn("category", F.pmod("item_id", F.lit(10)))
    asked = items.join(_centroid_queries(t).withColumnRenamed("query_id", "category"), "category").select(F.col("item_id").alias("query_id"), "text", "query")
    found = retrieval.hybrid(asked, chunks, s=VECTORS)
    return found.withColumns({"sparse": F.round("sparse", 6), "fused": F.round("fused", 9)})


# --- text ------------------------------------------------------------------

@query(with_views(*TEXTS[:2]) + "SELECT doc_id, n - 1 AS at, section, page, line FROM content")
def sections(t: Tables) -> DataFrame:
    return structuring.sections(t.resume_texts).select("doc_id", F.posexplode("lines").alias("at", "r")).select("doc_id", F.col("at").cast("long").alias("at"), "r.*")


@query(with_views(*TEXTS[:3]) + "SELECT doc_id, n - 1 AS at, CAST(s - 1 AS BIGINT) AS n, sentence FROM sents")
def sentence_split(t: Tables) -> DataFrame:
    lines = structuring.sections(t.resume_texts).select("doc_id", F.posexplode("lines").alias("at", "r"))
    cut = lines.select("doc_id", F.col("at").cast("long").alias("at"), F.posexplode(structuring.sentences(F.col("r.line"))).alias("n", "sentence"))
    return cut.withColumn("n", F.col("n").cast("long"))


@query(with_views(*TEXTS) + f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_position([{in_list(structuring.SECTIONS)}], section), i) - 1 AS chunk_id, section, page, text FROM chunked")
def chunks(t: Tables) -> DataFrame:
    return structuring.chunks(t.resume_texts)


WATCHED = ["the", "and", "c++", "der", "que", "idiot", "token"]


@query("SELECT doc_id, " + ", ".join(f"""regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){w.replace('+', '[+]')}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') AS has_{i}""" for i, w in enumerate(WATCHED)) + " FROM documents")
def term_match(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", *(requirements.contains_term(F.col("text"), F.lit(w)).alias(f"has_{i}") for i, w in enumerate(WATCHED)))


OUTSIDE = r"[^\p{L}\p{M}\p{N}_]"


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _terms_sql(text: str) -> str:
    """The watched terms that a text holds, in their order."""
    held = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i)(^|{OUTSIDE}){w.replace('+', '[+]')}($|{OUTSIDE})') THEN '{w}' END" for w in WATCHED)
    return f"list_filter([{held}], lambda w: w IS NOT NULL)"


@query(rf"""SELECT item_id, CAST(least(20 * len(list_distinct(list_concat({_terms_sql('lower(text)')},
  list_filter(list_transform(regexp_extract_all(text, {_quote(requirements.TECHNICAL)}), lambda t: regexp_replace(lower(t), '^[+#/.]+|[+#/.]+$', '', 'g')), lambda t: length(t) >= 2)))), 100) AS INT) AS specificity FROM benchmark""")
def tech_specificity(t: Tables) -> DataFrame:
    return t.read("benchmark").select("item_id", requirements.technical_specificity(F.col("text"), WATCHED).alias("specificity"))


def _job_texts(t: Tables) -> DataFrame:
    """Benchmark items with lines of a job description around them."""
    i, text = F.col("item_id"), F.coalesce("text", F.lit(""))
    head = F.when(i % 3 == 0, "Nice to have:").when(i % 3 == 1, "Requirements:").otherwise("About us")
    cue = F.when(i % 2 == 0, "Strong experience with Python, Spark and Kafka is required").otherwise("Docker and AWS knowledge would be a plus")
    parts = [text, F.lit("\n- Knowledge of SQL or Apache Airflow\n"), head, F.lit("\n* 3+ years with Google Cloud Platform; "), cue, F.lit("\nMust have:\nToken handling, the Token\n"), cue]
    return t.read("benchmark").select(i.alias("jd_id"), F.concat(*parts).alias("text"))


JOBS = """jobs AS (SELECT jd_id, coalesce(t, '') || chr(10) || '- Knowledge of SQL or Apache Airflow' || chr(10) || head || chr(10) || '* 3+ years with Google Cloud Platform; ' || cue || chr(10) || 'Must have:' || chr(10) || 'Token handling, the Token' || chr(10) || cue AS text
  FROM (SELECT item_id AS jd_id, text AS t, CASE item_id % 3 WHEN 0 THEN 'Nice to have:' WHEN 1 THEN 'Requirements:' ELSE 'About us' END AS head,
        CASE item_id % 2 WHEN 0 THEN 'Strong experience with Python, Spark and Kafka is required' ELSE 'Docker and AWS knowledge would be a plus' END AS cue FROM benchmark))"""
_R = requirements
_bare, _stop = "regexp_replace(lower(w), '[^a-z0-9]', '', 'g')", f"[{in_list(_R.STOP)}]"
REQUIREMENTS = rf"""WITH {JOBS}, raw AS (
  SELECT jd_id, i, regexp_replace(l, '^{WS}+|{WS}+$', '', 'g') AS line FROM (SELECT jd_id, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM (SELECT jd_id, string_split(text, chr(10)) AS a FROM jobs))),
lines AS (SELECT *, regexp_matches(line, {_quote(_R.LINE_HEADER)}) AS head FROM raw WHERE line <> ''),
asking AS (
  SELECT jd_id, i, line FROM (SELECT *, min(i) FILTER (head) OVER (PARTITION BY jd_id) AS first FROM lines)
  WHERE NOT head AND (coalesce(i > first, false) OR regexp_matches(line, {_quote(_R.BULLET)}) OR regexp_matches(line, {_quote('(?i)' + _R.CUE)}))),
joined AS (SELECT jd_id, string_agg(line, chr(10) ORDER BY i) AS j, flatten(list(regexp_extract_all(line, {_quote(_R.CAPITALISED)}, 1) ORDER BY i)) AS capital FROM asking GROUP BY 1),
phrases AS (
  SELECT jd_id, list_concat(flatten(list_transform(regexp_extract_all(j, {_quote(_R.CUE_AFTER)}, 1), lambda x: string_split_regex(x, {_quote(_R.SPLIT)}))), regexp_extract_all(j, {_quote(_R.CUE_BEFORE)}, 1), capital) AS p FROM joined),
words AS (
  SELECT jd_id, pos, list_filter(string_split_regex(trim(phrase), '\s+'), lambda w: w <> '') AS w FROM (SELECT jd_id, unnest(p) AS phrase, generate_subscripts(p, 1) AS pos FROM phrases)),
marked AS (SELECT *, list_transform(w, lambda w: NOT list_contains({_stop}, {_bare})) AS plain FROM words),
bounds AS (SELECT *, list_position(plain, true) AS a, len(plain) + 1 - list_position(list_reverse(plain), true) AS z FROM marked),
cleaned AS (SELECT jd_id, pos, regexp_replace(array_to_string(w[a:least(z, a + {_R.MOST_WORDS} - 1)], ' '), '^[ \-,/&]+|[ \-,/&]+$', '', 'g') AS phrase FROM bounds WHERE a > 0),
meant AS (SELECT jd_id, pos, phrase FROM cleaned WHERE len(list_filter(string_split_regex(phrase, '\s+'), lambda w: NOT list_contains({_stop}, {_bare}) AND length({_bare}) >= 2)) > 0),
named AS (
  SELECT jd_id, 0 AS k, pos, term AS display FROM (SELECT jd_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT jd_id, {_terms_sql('text')} AS t FROM jobs))
  UNION ALL SELECT jd_id, 1, pos, phrase FROM meant WHERE phrase <> ''
  UNION ALL SELECT jd_id, 2, 0, list_max(list_transform(regexp_extract_all(text, {_quote(_R.YEARS)}, 1), lambda x: x::BIGINT)) || '+ years experience' FROM jobs WHERE len(regexp_extract_all(text, {_quote(_R.YEARS)}, 1)) > 0),
once AS (SELECT * FROM (SELECT *, lower(display) AS key, row_number() OVER (PARTITION BY jd_id, lower(display) ORDER BY k, pos) AS r FROM named) WHERE r = 1),
few AS (SELECT * FROM (SELECT jd_id, key, display, row_number() OVER (PARTITION BY jd_id ORDER BY k, pos) AS n FROM once) WHERE n <= {_R.MOST_PHRASES}),
parts AS (SELECT DISTINCT jd_id, unnest(string_split(display, ' ')) AS key FROM few WHERE contains(display, ' ')),
requirements AS (SELECT jd_id, display AS requirement FROM few f WHERE contains(display, ' ') OR key IN ({in_list(WATCHED)}) OR NOT EXISTS (SELECT 1 FROM parts p WHERE p.jd_id = f.jd_id AND p.key = f.key))
"""


@query(REQUIREMENTS + "SELECT jd_id, requirement FROM requirements")
def requirement_extract(t: Tables) -> DataFrame:
    return requirements.extract_requirements(_job_texts(t), "jd_id", "text", WATCHED)


PRIORITIES = rf""", placed AS (
  SELECT jd_id, line, coalesce(cue, last_value(context IGNORE NULLS) OVER (PARTITION BY jd_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'must') AS priority
  FROM (SELECT jd_id, i, line, CASE WHEN regexp_matches(line, {_quote(_R.NICE_HEADER)}) THEN 'nice' WHEN regexp_matches(line, {_quote(_R.MUST_HEADER)}) THEN 'must' END AS context,
               CASE WHEN regexp_matches(line, {_quote(_R.NICE_CUE)}) THEN 'nice' WHEN regexp_matches(line, {_quote(_R.MUST_CUE)}) THEN 'must' END AS cue FROM lines)),
seen AS (SELECT r.jd_id, r.requirement, bool_and(priority = 'nice') AS nice FROM requirements r JOIN placed p ON p.jd_id = r.jd_id AND regexp_matches(p.line, '(?i)(^|{OUTSIDE})' || regexp_escape(r.requirement) || '($|{OUTSIDE})') GROUP BY ALL),
weighed AS (SELECT r.jd_id, r.requirement, CASE WHEN nice THEN 'nice' ELSE 'must' END AS importance, CASE WHEN nice THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM requirements r LEFT JOIN seen s ON s.jd_id = r.jd_id AND s.requirement = r.requirement)"""


@query(REQUIREMENTS + PRIORITIES + "SELECT * FROM weighed")
def priorities(t: Tables) -> DataFrame:
    jobs = _job_texts(t)
    return requirements.priorities(requirements.extract_requirements(jobs, "jd_id", "text", WATCHED), jobs)


pipeline_catalog.register((REQUIREMENTS + PRIORITIES).removeprefix("WITH "), _job_texts, WATCHED)


@query(r"""WITH y AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)([0-9]{1,9}(?:\.[0-9]{1,9})?)\s*\+?\s*years?', 1), lambda x: x::DOUBLE) AS stated, list_transform(regexp_extract_all(text, '\b((?:19|20)[0-9]{2})\b', 1), lambda x: x::INT) AS named FROM documents),
z AS (SELECT doc_id, coalesce(list_max(stated), CASE WHEN list_max(named) - list_min(named) BETWEEN 1 AND 50 THEN (list_max(named) - list_min(named))::DOUBLE END) AS total_years FROM y)
SELECT doc_id, total_years, CASE WHEN total_years >= 8 THEN 'Lead' WHEN total_years >= 5 THEN 'Senior' WHEN total_years >= 2 THEN 'Mid' WHEN total_years IS NOT NULL THEN 'Junior' END AS seniority_level, CASE WHEN total_years IS NULL THEN 'Unknown' WHEN total_years >= 5 THEN 'Exceeds' WHEN total_years >= 3 THEN 'Meets' ELSE 'Below' END AS seniority_fit FROM z""")
def profile(t: Tables) -> DataFrame:
    rows = t.read("documents").select("doc_id", F.col("text").alias("resume_text"), F.lit("3+ years").alias("jd_text"))
    return profile_.profiles(rows).select("doc_id", "total_years", "seniority_level", "seniority_fit")


@query("""WITH q AS (SELECT o_orderkey AS analysis_id, 'Ask about ' || c_name || ' and ' || c_mktsegment AS question, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT analysis_id, question, CASE WHEN length(c_name) >= length(c_mktsegment) THEN c_name ELSE c_mktsegment END AS requirement FROM q""")
def interview_match(t: Tables) -> DataFrame:
    rows = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    asked = rows.select(F.col("o_orderkey").alias("analysis_id"), F.lit(1).alias("question_id"), F.concat(F.lit("Ask about "), "c_name", F.lit(" and "), "c_mktsegment").alias("question"))
    names = rows.select(F.col("o_orderkey").alias("analysis_id"), F.posexplode(F.array("c_name", "c_mktsegment", F.lit("absent"))).alias("position", "requirement"), F.lit("Matched").alias("status"), F.lit("").alias("evidence"), F.lit(50).alias("confidence"))
    return scoring.interview_match(asked, names).select("analysis_id", "question", "requirement")


# --- input, output and changes ----------------------------------------------


@query(with_views(*SCORING) + "SELECT analysis_id, overall_score, missing_count AS missing, 'ok' AS state FROM scored")
def report_roundtrip(t: Tables) -> DataFrame:
    reports = scoring.reports(scoring.verdicts(t.requirements, t.matches)).withColumn("summary", F.lit("-"))
    body = reports.select("analysis_id", F.to_json(F.struct(*reports.columns)).alias("body"))
    back = files.parse_reports(body)
    return back.select("analysis_id", F.col("report.overall_score").cast("long").alias("overall_score"), F.size("report.missing_skills").cast("long").alias("missing"), "state")


@query("SELECT conv_id AS note_id, arg_max(text, turn) FILTER (trim(text) <> '') AS text, arg_max(role, turn) FILTER (trim(role) <> '') AS author FROM (SELECT conv_id, turn, nullif(trim(text), '') AS text, nullif(trim(role), '') AS role FROM conversations) GROUP BY 1")
def notes_latest(t: Tables) -> DataFrame:
    log = t.read("conversations").select(F.col("conv_id").alias("note_id"), F.col("turn").alias("seq"), F.lit("update").alias("op"), "text", F.col("role").alias("author"), F.col("turn").alias("at"))
    return dml.latest_notes(log).select("note_id", "text", "author")


@query("SELECT count(*) AS items, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def delete_cascade(t: Tables) -> DataFrame:
    gone = t.read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    _, left = dml.delete_analyses(t.analyses, t.read("lineitem").withColumnRenamed("l_orderkey", "analysis_id"), gone)
    return left.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.col("l_linenumber").cast("long")), F.lit(0)).alias("numbers"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::DOUBLE AS price FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_retailprice FROM part")
def schema_evolve(t: Tables) -> DataFrame:
    old = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return dml.union_evolving(old, t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))).select("id", "name", "balance", "price")


@query("SELECT doc_id, left(sha256(text), 32) AS sha FROM documents")
def fingerprint(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", S.fingerprint(F.col("text")).alias("sha"))


@query(with_views("analyses") + "SELECT DISTINCT resume_id, jd_id FROM analyses a WHERE NOT EXISTS (SELECT 1 FROM analyses b WHERE b.overall_score IS NOT NULL AND a.resume_id = b.resume_id AND a.jd_id = b.jd_id)")
def new_pairs(t: Tables) -> DataFrame:
    done = t.analyses.where("overall_score IS NOT NULL").select("resume_id", "jd_id")
    return dml.get_or_create(done, t.analyses.select("resume_id", "jd_id"))


@query("SELECT page_id, md5(html) AS etag, CASE WHEN lower(url) LIKE '%.pdf' THEN '.pdf' WHEN lower(url) LIKE '%.docx' THEN '.docx' END AS kind FROM pages")
def file_tags(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", F.md5(F.col("html").cast("binary")).alias("etag"), files.file_kind(F.col("url")).alias("kind"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[",\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END AS field FROM conversations""")
def csv_fields(t: Tables) -> DataFrame:
    return t.read("conversations").select("conv_id", "turn", S.csv_field(F.col("text")).alias("field"))


@query("SELECT p_partkey, least(10, greatest(0, floor((p_retailprice / 2000.0::DOUBLE + 1) * 5 * 100 + 0.5) / 100)) AS trait FROM part")
def trait_scores(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", S.trait_scale(F.col("p_retailprice") / 2000.0).alias("trait"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
