"""The whole chain from documents to leaderboards as a registered query, with its SQL form."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bound, normalised
from ..operators import requirements as R
from ..operators import retrieval, structuring
from ..settings import DEFAULTS, FALLBACK_CATEGORY, TAXONOMY, taxonomy_terms
from ..sources.views import TEXTS, Tables, in_list, with_views
from . import evaluation
from .registry import query

#: Thresholds that suit the vectors below.
HASHED = replace(DEFAULTS, similarity_floor=0.15, category_floor=0.2, equivalent_min=0.8, related_min=0.5)
WIDTH = 32
HEX = "0123456789abcdef"
OUTSIDE = r"[^\p{L}\p{M}\p{N}_]"


def digest_vector(text: Column) -> Column:
    """A unit vector of token counts, place and sign of a token by its MD5: an encoder that SQL can state as well.

    A token becomes one of 64 characters, for its place and sign, and a place's number is how many more characters
    are left without those of its minus than without those of its plus.
    """
    value = lambda t: F.conv(F.substring(F.md5(t), 1, 3), 16, 10).cast("int")
    mark = lambda x: F.char(F.shiftright(x, 4).bitwiseAND(31) * 2 + x.bitwiseAND(1) + 48)
    marks = F.array_join(F.transform(retrieval.tokens(text), lambda t: mark(value(t))), "")
    without = lambda held, n: F.octet_length(F.replace(held, F.lit(chr(48 + n))))
    return normalised(bound(marks, lambda held: F.array(*((without(held, 2 * i + 1) - without(held, 2 * i)).cast("double") for i in range(WIDTH)))))


def _vector_sql(text: str) -> str:
    digit = lambda k: f"(instr('{HEX}', substr(md5(t), {k}, 1)) - 1)"
    places = f"list_transform(regexp_extract_all(lower({text}), '{retrieval.TOKEN}'), lambda t: {{'at': {digit(1)} % 2 * 16 + {digit(2)}, 'sign': 1.0::DOUBLE - {digit(3)} % 2 * 2}})"
    return f"list_transform(range({WIDTH}), lambda i: coalesce(list_sum(list_transform({places}, lambda p: CASE WHEN p.at = i THEN p.sign ELSE 0::DOUBLE END)), 0::DOUBLE))"


def _unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / (sqrt(list_dot_product({v}, {v})) + 1e-9))"


def _terms_sql(text: str, terms: list[str]) -> str:
    held = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i)(^|{OUTSIDE}){re.escape(w).replace('/', '[/]')}($|{OUTSIDE})') THEN '{w}' END" for w in terms)
    return f"list_filter([{held}], lambda w: w IS NOT NULL)"


def _chain_sql(job_parts: str) -> str:
    """``job_parts`` is the requirement and priority views of the job texts, without their WITH."""
    half = lambda x, n: f"floor(({x}) * {10**n}::DOUBLE + 0.5::DOUBLE) / {10**n}::DOUBLE"
    tokens, terms = f"regexp_extract_all(lower(text), '{retrieval.TOKEN}')", taxonomy_terms()
    listed = ", ".join(f"('{c}', '{t}')" for c, ts in TAXONOMY.items() for t in ts)
    trimmed = "regexp_replace(w, '^[+#/.]+|[+#/.]+$', '', 'g')"
    return with_views(*TEXTS) + ", " + job_parts.replace("lines", "job_lines").replace("classed", "job_classed") + rf""",
asked AS MATERIALIZED (SELECT jd_id, requirement, importance, weight, row_number() OVER (PARTITION BY jd_id ORDER BY lower(requirement), requirement) AS position, {_unit_sql('v')} AS vector FROM (SELECT *, {_vector_sql('requirement')} AS v FROM weighed)),
nodes AS MATERIALIZED (
  SELECT *, {_unit_sql('v')} AS embedding FROM (SELECT doc_id, section, text, row_number() OVER (PARTITION BY doc_id ORDER BY list_position([{in_list(structuring.SECTIONS)}], section), i) - 1 AS chunk_id, {_vector_sql('text')} AS v,
    least(20 * len(list_distinct(list_concat({_terms_sql('lower(text)', terms)}, list_filter(list_transform(regexp_extract_all(text, '{R.TECHNICAL}'), lambda t: regexp_replace(lower(t), '^[+#/.]+|[+#/.]+$', '', 'g')), lambda t: length(t) >= 2)))), 100) AS technical FROM chunked)),
pairs AS (SELECT doc_id AS analysis_id, doc_id, doc_id % (SELECT count(*) FROM benchmark) AS jd_id FROM documents),
wanted AS (SELECT analysis_id, doc_id, p.jd_id, requirement, importance, weight, position, vector FROM pairs p JOIN asked USING (jd_id)),
near AS (SELECT * FROM (SELECT w.analysis_id, w.doc_id, requirement, chunk_id, section, trim(text) AS chunk, technical, list_dot_product(vector, embedding) AS cosine, row_number() OVER (PARTITION BY analysis_id, requirement ORDER BY list_dot_product(vector, embedding) DESC, chunk_id) AS place FROM wanted w JOIN nodes USING (doc_id)) WHERE place <= 12),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, requirement, chunk ORDER BY place) AS copy FROM near) WHERE copy = 1 AND {half('cosine', 3)} >= 0.15),
cut AS (SELECT doc_id, chunk_id, {tokens} AS t FROM nodes),
size AS (SELECT doc_id, count(*) AS n, avg(len(t)) AS avg_len FROM cut GROUP BY 1),
tf AS MATERIALIZED (SELECT doc_id, chunk_id, len AS doc_len, term, count(*) AS tf FROM (SELECT doc_id, chunk_id, len(t) AS len, unnest(t) AS term FROM cut) GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
said AS (SELECT doc_id, requirement, term, count(*) AS qtf FROM (SELECT doc_id, requirement, unnest(regexp_extract_all(lower(requirement), '{retrieval.TOKEN}')) AS term FROM (SELECT DISTINCT doc_id, requirement FROM wanted)) GROUP BY ALL),
bm AS (SELECT doc_id, requirement, chunk_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))) AS sparse FROM said JOIN tf USING (doc_id, term) JOIN df USING (doc_id, term) JOIN size USING (doc_id) GROUP BY ALL),
judged AS (SELECT p.*, round(coalesce(sparse, 0), 9) AS sparse, least(100, greatest(0, CAST(trunc(least(100::DOUBLE, greatest(0::DOUBLE, cosine * 100::DOUBLE)) * 0.7::DOUBLE + (CASE section WHEN 'Experience' THEN 100 WHEN 'Projects' THEN 80 WHEN 'Skills' THEN 30 ELSE 0 END) * 0.15::DOUBLE
  + (CASE WHEN length(chunk) > 150 THEN 100 WHEN length(chunk) > 70 THEN 70 WHEN length(chunk) > 30 THEN 30 ELSE 0 END) * 0.05::DOUBLE + technical * 0.1::DOUBLE) AS BIGINT))) AS confidence FROM pool p LEFT JOIN bm USING (doc_id, requirement, chunk_id)),
placed_ AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, requirement ORDER BY confidence DESC, place) - 1 AS dr, row_number() OVER (PARTITION BY analysis_id, requirement ORDER BY sparse DESC, place) - 1 AS sr FROM judged),
found AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, requirement ORDER BY 0.6::DOUBLE / (60 + dr) + 0.4::DOUBLE / (60 + sr) DESC, place) AS rank FROM placed_) WHERE rank <= 3),
mentioned AS (SELECT analysis_id, chunk, section, rank, unnest(list_distinct(list_concat({_terms_sql('lower(chunk)', terms)}, list_transform(list_filter(list_transform(regexp_extract_all(chunk, '{R.WORD}'), lambda w: {trimmed}),
  lambda w: length(w) >= 2 AND (regexp_matches(w, '[0-9+#/.]') OR (upper(w) = w AND lower(w) <> w) OR substr(w, 2) <> lower(substr(w, 2)))), lambda w: lower(w))))) AS skill FROM found),
skills AS (SELECT * FROM (SELECT *, section IN ('Experience', 'Projects') AS narrative, row_number() OVER (PARTITION BY analysis_id, skill ORDER BY section IN ('Experience', 'Projects') DESC, rank, chunk, section) AS r FROM mentioned) WHERE r = 1),
listed AS (SELECT category, {_unit_sql('v')} AS vector FROM (SELECT category, {_vector_sql('term')} AS v FROM (VALUES {listed}) x(category, term))),
middles AS (SELECT category, {_unit_sql('v')} AS centroid FROM (SELECT category, list(x ORDER BY pos) AS v FROM (SELECT category, pos, avg(x) AS x FROM (SELECT category, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM listed) GROUP BY ALL) GROUP BY 1)),
names AS (SELECT DISTINCT name FROM (SELECT skill AS name FROM skills UNION ALL SELECT requirement FROM asked)),
kinds AS MATERIALIZED (SELECT name, vector, (SELECT CASE WHEN max(list_dot_product(vector, centroid)) >= 0.2 THEN arg_max(category, (list_dot_product(vector, centroid), category)) ELSE '{FALLBACK_CATEGORY}' END FROM middles) AS category FROM (SELECT name, {_unit_sql('v')} AS vector FROM (SELECT name, {_vector_sql('name')} AS v FROM names))),
beside AS (SELECT w.analysis_id, w.requirement, s.skill, s.narrative, a.category = b.category AS same, list_dot_product(a.vector, b.vector) AS cosine FROM wanted w JOIN skills s USING (analysis_id) JOIN kinds a ON a.name = w.requirement JOIN kinds b ON b.name = s.skill WHERE lower(w.requirement) <> lower(s.skill)),
tied AS (SELECT analysis_id, requirement, max(cosine) >= 0.8 AS equivalent, {half('max(cosine)', 3)} AS cosine, arg_max(narrative, (cosine, skill)) AS narrative FROM beside GROUP BY ALL),
best AS (SELECT analysis_id, requirement, max((confidence::DOUBLE, section, chunk, confidence)) AS b, max((confidence::DOUBLE, section, chunk, confidence)) FILTER (section IN ('Experience', 'Projects')) AS shown FROM found GROUP BY ALL),
verdict AS (
  SELECT w.analysis_id, w.weight, b IS NOT NULL AS claimed, b IS NOT NULL OR coalesce(t.equivalent, false) AS covered, shown IS NOT NULL AS demonstrated, b[2] AS section,
    CASE WHEN b IS NOT NULL THEN b[4] WHEN t.equivalent THEN CAST(trunc(t.cosine * 100) AS BIGINT) ELSE 0 END AS confidence,
    CASE WHEN b IS NOT NULL THEN CASE WHEN b[4] >= 75 THEN 'Matched' ELSE 'Partial' END WHEN t.equivalent THEN CASE WHEN t.narrative THEN 'Matched' ELSE 'Partial' END ELSE 'Missing' END AS status,
    CASE WHEN shown IS NULL THEN NULL WHEN length(shown[3]) > 150 THEN 100 WHEN length(shown[3]) > 70 THEN 70 WHEN length(shown[3]) > 30 THEN 30 ELSE 0 END AS depth
  FROM wanted w LEFT JOIN best USING (analysis_id, requirement) LEFT JOIN tied t USING (analysis_id, requirement)),
sums AS (
  SELECT analysis_id, coalesce(CAST(trunc({half("sum(CASE WHEN covered THEN weight ELSE 0 END) / nullif(sum(weight), 0) * 100", 6)}) AS BIGINT), 0) AS coverage_score,
    CAST(trunc(count(*) FILTER (section = 'Experience') / count(*)::DOUBLE * 100) AS BIGINT) AS experience, CAST(trunc(count(*) FILTER (section = 'Projects') / count(*)::DOUBLE * 100) AS BIGINT) AS project, CAST(trunc(coalesce(avg(confidence) FILTER (covered), 0)) AS BIGINT) AS sure,
    count(*) FILTER (status = 'Matched') AS matched_count, count(*) FILTER (status = 'Partial') AS partial_count, count(*) FILTER (status = 'Missing') AS missing_count,
    coalesce({half("count(*) FILTER (demonstrated) / nullif(count(*) FILTER (claimed), 0)::DOUBLE", 2)}, 0) AS ratio, coalesce(avg(depth), 0)::DOUBLE AS depth FROM verdict GROUP BY 1),
total AS (SELECT *, least(100, greatest(0, CAST(trunc(coverage_score * 0.35::DOUBLE + experience * 0.25::DOUBLE + project * 0.2::DOUBLE + sure * 0.15::DOUBLE
  + least(100, greatest(0, CAST(round_even(CAST(round_even(ratio * 100, 0) AS BIGINT) * 0.6::DOUBLE + depth * 0.4::DOUBLE, 0) AS BIGINT))) * 0.05::DOUBLE) AS BIGINT))) AS overall_score FROM sums)
SELECT p.jd_id, p.doc_id AS resume_id, row_number() OVER (PARTITION BY p.jd_id ORDER BY t.overall_score IS NULL, t.overall_score DESC NULLS LAST, p.analysis_id) AS rank, t.overall_score, t.coverage_score, t.matched_count, t.partial_count, t.missing_count
FROM pairs p LEFT JOIN total t USING (analysis_id)"""


@query(f"""WITH known AS (SELECT term, row_number() OVER (ORDER BY length(term) DESC, term) AS place FROM (SELECT DISTINCT unnest([{in_list(taxonomy_terms())}]) AS term)),
held AS (SELECT term, count(*) AS documents FROM (SELECT unnest({_terms_sql("text", taxonomy_terms())}) AS term FROM documents) GROUP BY 1)
SELECT place, term, coalesce(documents, 0) AS documents FROM known LEFT JOIN held USING (term)""")
def taxonomy(t: Tables) -> DataFrame:
    """The taxonomy's terms in their order, with the number of documents that hold each."""
    return R.term_documents(t.read("documents"))


def register(job_parts: str, job_texts, terms: list[str]) -> None:
    @query(_chain_sql(job_parts))
    def documents_to_leaderboard(t: Tables) -> DataFrame:
        """Every document is a resume that applies to one benchmark item's job."""
        docs, n = t.resume_texts, t.read("benchmark").agg(F.count(F.lit(1)).alias("n")).scalar()
        resumes = docs.select(F.col("doc_id").alias("resume_id"), F.col("doc_id").alias("candidate_id"), F.lit("-").alias("filename"), "text")
        pairs = docs.select(F.col("doc_id").alias("analysis_id"), F.col("doc_id").alias("resume_id"), (F.col("doc_id") % n).alias("jd_id"))
        ranking, scores = evaluation.leaderboards(resumes, job_texts(t), pairs, digest_vector, terms, HASHED)
        extra = scores.select(F.col("analysis_id").alias("resume_id"), "coverage_score", "matched_count", "partial_count", "missing_count")
        return ranking.join(extra, "resume_id", "left").select("jd_id", "resume_id", "rank", "overall_score", "coverage_score", "matched_count", "partial_count", "missing_count")
