"""The driver's star-schema tables under the engine's own names.

Each view has a DataFrame form and an SQL form, so that a query and its oracle
start from the same columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.structuring import ABBREVIATIONS, HEADINGS


HEADS = ("Technical Skills:", "WORK EXPERIENCE", "Projects", "Education", "Certifications", "No such heading")


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def analyses(self) -> DataFrame:
        """One per order; orders of status P have no score yet."""
        orders, parts = self.read("orders"), self.read("part").agg(F.count(F.lit(1)).alias("n")).scalar()
        price = F.floor("o_totalprice")
        score = lambda step: F.when(F.col("o_orderstatus") != "P", F.floor(price / step) % 101)
        return orders.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("resume_id"), (F.col("o_orderkey") % parts).alias("jd_id"),
            score(1).alias("overall_score"), score(3).alias("coverage_score"), score(7).alias("experience_score"), score(11).alias("project_score"), score(13).alias("quality_score"),
            F.when(F.col("o_orderpriority").startswith("1"), "Applied").when(F.col("o_orderpriority").startswith("2"), "").otherwise("Screening").alias("workflow_status"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def bulk(self) -> DataFrame:
        """One per line item, for aggregates that need no id of their own."""
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("resume_id"), F.col("l_partkey").alias("jd_id"),
            F.floor(F.col("l_quantity") * 2).alias("overall_score"), F.floor(F.col("l_quantity")).alias("coverage_score"), (F.col("l_linenumber") * 10).cast("long").alias("experience_score"),
            F.floor(F.col("l_extendedprice") % 101.0).alias("project_score"), F.when(F.col("l_linestatus") == "O", F.lit(50)).cast("long").alias("quality_score"), F.lit("Applied").alias("workflow_status"), F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def resumes(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("filename"))

    @cached_property
    def jobs(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("filename"))

    @cached_property
    def resume_texts(self) -> DataFrame:
        """Each document twice, with headings, a page mark and abbreviations around it."""
        docs = self.read("documents")
        body, head = F.coalesce("text", F.lit("")), lambda k: F.element_at(F.array(*map(F.lit, HEADS)), (F.pmod(F.col("doc_id") + k, F.lit(len(HEADS))) + 1).cast("int"))
        parts = [body, "\n", head(0), "\nMet Dr. Smith, e.g. at ", F.coalesce("source", F.lit("")), ". Then J. Doe left.\n--- PAGE ", (F.pmod("doc_id", F.lit(7)) + 2).cast("string"), " ---\n", head(1), "\n", body]
        return docs.select("doc_id", F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("text"))

    @cached_property
    def evidence(self) -> DataFrame:
        """Requirement rows with or without a match, by order: lines of status O have none."""
        items, parts = self.read("lineitem"), self.read("part")
        joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        return joined.select(
            F.col("l_orderkey").alias("analysis_id"), F.col("p_brand").alias("requirement"),
            F.when(F.col("l_linestatus") == "F", F.repeat(F.col("p_name"), F.col("l_linenumber"))).alias("chunk"),
            F.when(F.col("l_returnflag") == "A", "Experience").when(F.col("l_returnflag") == "R", "Projects").otherwise("Skills").alias("section"),
            F.col("l_discount").alias("score"), F.when(F.col("l_quantity") > 5, F.floor(F.col("l_quantity") * 2)).alias("confidence"),
            F.col("p_size").cast("long").alias("p_size"), F.col("p_partkey"),
        )

    @cached_property
    def requirements(self) -> DataFrame:
        nice = F.min("p_size") % 2 == 0
        return self.evidence.groupBy("analysis_id", "requirement").agg(F.min("p_partkey").alias("position"), F.when(nice, "nice").otherwise("must").alias("importance"), F.when(nice, F.lit(0.4)).otherwise(F.lit(1.0)).alias("weight"))

    @cached_property
    def matches(self) -> DataFrame:
        return self.evidence.where("chunk IS NOT NULL").select("analysis_id", "requirement", "chunk", "section", "score", "confidence")


WS = r"[ \t\n\x0B\f\r]"


def in_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _score_sql(step: int) -> str:
    return f"CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(floor(o_totalprice) / {step}.0) AS BIGINT) % 101 END"


SQL = {
    "analyses": f"""analyses AS (
  SELECT o_orderkey AS id, o_custkey AS resume_id, o_orderkey % (SELECT count(*) FROM part) AS jd_id, {_score_sql(1)} AS overall_score, {_score_sql(3)} AS coverage_score,
         {_score_sql(7)} AS experience_score, {_score_sql(11)} AS project_score, {_score_sql(13)} AS quality_score,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'Applied' WHEN o_orderpriority LIKE '2%' THEN '' ELSE 'Screening' END AS workflow_status, o_orderdate AS created_at
  FROM orders)""",
    "bulk": """bulk AS (
  SELECT l_orderkey AS id, l_suppkey AS resume_id, l_partkey AS jd_id, CAST(floor(l_quantity * 2) AS BIGINT) AS overall_score, CAST(floor(l_quantity) AS BIGINT) AS coverage_score,
         CAST(l_linenumber * 10 AS BIGINT) AS experience_score, CAST(floor(l_extendedprice % 101.0::DOUBLE) AS BIGINT) AS project_score, CASE WHEN l_linestatus = 'O' THEN 50::BIGINT END AS quality_score, l_shipdate AS created_at
  FROM lineitem)""",
    "star": """star AS (
  SELECT a.*, c.c_name AS resume_filename, p.p_name AS jd_filename FROM analyses a JOIN customer c ON a.resume_id = c.c_custkey JOIN part p ON a.jd_id = p.p_partkey WHERE overall_score IS NOT NULL)""",
    "evidence": """evidence AS (
  SELECT l_orderkey AS analysis_id, p_brand AS requirement, CASE WHEN l_linestatus = 'F' THEN repeat(p_name, l_linenumber) END AS chunk,
         CASE l_returnflag WHEN 'A' THEN 'Experience' WHEN 'R' THEN 'Projects' ELSE 'Skills' END AS section, l_discount AS score,
         CASE WHEN l_quantity > 5 THEN CAST(floor(l_quantity * 2) AS BIGINT) END AS confidence, p_size, p_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "requirements": """requirements AS (
  SELECT analysis_id, requirement, min(p_partkey) AS position, CASE WHEN min(p_size) % 2 = 0 THEN 'nice' ELSE 'must' END AS importance, CASE WHEN min(p_size) % 2 = 0 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM evidence GROUP BY ALL)""",
    "ranked_matches": """ranked_matches AS (
  SELECT *, row_number() OVER (PARTITION BY analysis_id, requirement ORDER BY coalesce(confidence::DOUBLE, score * 100) DESC, section DESC, chunk DESC, conf DESC) AS r,
         row_number() OVER (PARTITION BY analysis_id, requirement, section IN ('Experience', 'Projects') ORDER BY coalesce(confidence::DOUBLE, score * 100) DESC, section DESC, chunk DESC, conf DESC) AS nr
  FROM (SELECT *, coalesce(confidence, least(100, greatest(0, CAST(trunc(least(100::DOUBLE, greatest(0::DOUBLE, score * 100::DOUBLE)) * 0.7::DOUBLE
          + (CASE section WHEN 'Experience' THEN 100 WHEN 'Projects' THEN 80 ELSE 30 END) * 0.15::DOUBLE + 30 * 0.05::DOUBLE + 40 * 0.1::DOUBLE) AS BIGINT)))) AS conf
        FROM evidence WHERE chunk IS NOT NULL))""",
    "verdicts": """verdicts AS (
  SELECT q.*, CASE WHEN b.conf >= 75 THEN 'Matched' WHEN b.conf IS NOT NULL THEN 'Partial' ELSE 'Missing' END AS status, coalesce(b.conf, 0) AS confidence, b.section, coalesce(b.chunk, '') AS evidence,
         b.conf IS NOT NULL AS covered, n.conf IS NOT NULL AS demonstrated,
         CASE WHEN n.conf IS NULL THEN NULL WHEN length(n.chunk) > 150 THEN 100 WHEN length(n.chunk) > 70 THEN 70 WHEN length(n.chunk) > 30 THEN 30 ELSE 0 END AS depth
  FROM requirements q
  LEFT JOIN (SELECT * FROM ranked_matches WHERE r = 1) b USING (analysis_id, requirement)
  LEFT JOIN (SELECT * FROM ranked_matches WHERE nr = 1 AND section IN ('Experience', 'Projects')) n USING (analysis_id, requirement))""",
    "authentic": """authentic AS (
  SELECT *, CASE WHEN claimed = 0 THEN 'Low' WHEN (claimed - demonstrated) / claimed::DOUBLE >= 0.5 THEN 'High' WHEN (claimed - demonstrated) / claimed::DOUBLE >= 0.25 THEN 'Medium' ELSE 'Low' END AS keyword_stuffing_risk,
         least(100, greatest(0, CAST(round_even(credibility_score * 0.6::DOUBLE + depth * 0.4::DOUBLE, 0) AS BIGINT))) AS quality_score
  FROM (SELECT *, CAST(round_even(corroboration_ratio * 100, 0) AS BIGINT) AS credibility_score
        FROM (SELECT *, coalesce(floor(demonstrated / nullif(claimed, 0)::DOUBLE * 100 + 0.5) / 100, 0) AS corroboration_ratio
              FROM (SELECT analysis_id, count(*) FILTER (covered) AS claimed, count(*) FILTER (demonstrated) AS demonstrated, coalesce(avg(depth), 0)::DOUBLE AS depth FROM verdicts GROUP BY 1))))""",
    "scored": """scored AS (
  SELECT *, least(100, greatest(0, CAST(trunc(coverage_score * 0.35::DOUBLE + experience_score * 0.25::DOUBLE + project_score * 0.2::DOUBLE + confidence_score * 0.15::DOUBLE + quality_score * 0.05::DOUBLE) AS BIGINT))) AS overall_score
  FROM (SELECT analysis_id, coalesce(CAST(trunc(floor(sum(CASE WHEN covered THEN weight ELSE 0 END) / nullif(sum(weight), 0) * 100 * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE) AS BIGINT), 0) AS coverage_score,
               CAST(trunc(count(*) FILTER (section = 'Experience') / count(*)::DOUBLE * 100) AS BIGINT) AS experience_score, CAST(trunc(count(*) FILTER (section = 'Projects') / count(*)::DOUBLE * 100) AS BIGINT) AS project_score,
               CAST(trunc(coalesce(avg(confidence) FILTER (covered), 0)) AS BIGINT) AS confidence_score,
               count(*) FILTER (status = 'Matched') AS matched_count, count(*) FILTER (status = 'Partial') AS partial_count, count(*) FILTER (status = 'Missing') AS missing_count
        FROM verdicts GROUP BY 1) JOIN authentic USING (analysis_id))""",
}
_head = " ".join(f"WHEN clean IN ({in_list(words.split('|'))}) THEN '{name}'" for name, words in HEADINGS.items())
SQL |= {
    "resume_texts": f"""resume_texts AS (
  SELECT doc_id, coalesce(text, '') || chr(10) || ([{in_list(HEADS)}])[doc_id % 6 + 1] || chr(10) || 'Met Dr. Smith, e.g. at ' || coalesce(source, '') || '. Then J. Doe left.' || chr(10)
         || '--- PAGE ' || (doc_id % 7 + 2) || ' ---' || chr(10) || ([{in_list(HEADS)}])[(doc_id + 1) % 6 + 1] || chr(10) || coalesce(text, '') AS text FROM documents)""",
    "content": f"""lines AS (
  SELECT doc_id, i, line FROM (SELECT doc_id, i, regexp_replace(l, '^{WS}+|{WS}+$', '', 'g') AS line FROM (SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM resume_texts))) WHERE line <> ''),
classed AS (
  SELECT *, CASE WHEN mark IS NULL AND length(line) < 40 THEN CASE {_head} END END AS head
  FROM (SELECT *, CAST(nullif(regexp_extract(line, '(?i)^---{WS}*PAGE{WS}+([0-9]{{1,9}}){WS}*---$', 1), '') AS INT) AS mark, trim(lower(regexp_replace(line, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s&]', '', 'g'))) AS clean FROM lines)),
content AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, section, page, line
  FROM (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER w, 'Summary') AS section, coalesce(last_value(mark IGNORE NULLS) OVER w, 1) AS page FROM classed WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WHERE head IS NULL AND mark IS NULL)""",
    "sents": f"""pieces AS (
  SELECT *, lower(regexp_extract(lag(piece) OVER (PARTITION BY doc_id, n ORDER BY k), '([^ \\t\\n\\x0B\\f\\r]+)$', 1)) AS word
  FROM (SELECT doc_id, n, section, page, k, regexp_replace(p, '^{WS}+|{WS}+$', '', 'g') AS piece FROM (SELECT doc_id, n, section, page, unnest(a) AS p, generate_subscripts(a, 1) AS k
        FROM (SELECT *, string_split(regexp_replace(line, '([.!?]){WS}+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS a FROM content))) WHERE piece <> ''),
sents AS (
  SELECT doc_id, n, section, page, s, string_agg(piece, ' ' ORDER BY k) AS sentence
  FROM (SELECT *, sum(CASE WHEN word IN ({in_list(ABBREVIATIONS)}) OR regexp_matches(word, '^[a-z][.]$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, n ORDER BY k) AS s FROM pieces) GROUP BY ALL)""",
    "chunked": """folded AS (
  SELECT doc_id, section, list_reduce(list({'s': sentence, 'p': page} ORDER BY n, s), lambda a, x: CASE
      WHEN a.n > 0 AND a.size >= 350 AND a.size + length(x.s) + 1 > 600 THEN
        CASE WHEN length(a.last) + 1 + length(x.s) + 1 >= 600
             THEN {'out': a.out || [{'t': trim(a.text), 'p': a.page}, {'t': trim(a.last || ' ' || x.s), 'p': a.last_page}], 'text': '', 'page': 0, 'last': '', 'last_page': 0, 'size': 0, 'n': 0}
             ELSE {'out': a.out || [{'t': trim(a.text), 'p': a.page}], 'text': a.last || ' ' || x.s, 'page': a.last_page, 'last': x.s, 'last_page': x.p, 'size': length(a.last) + 1 + length(x.s) + 1, 'n': 2} END
      WHEN a.size + length(x.s) + CASE WHEN a.n > 0 THEN 1 ELSE 0 END >= 600
        THEN {'out': a.out || [{'t': trim(CASE WHEN a.n > 0 THEN a.text || ' ' || x.s ELSE x.s END), 'p': CASE WHEN a.n > 0 THEN a.page ELSE x.p END}], 'text': '', 'page': 0, 'last': '', 'last_page': 0, 'size': 0, 'n': 0}
      ELSE {'out': a.out, 'text': CASE WHEN a.n > 0 THEN a.text || ' ' || x.s ELSE x.s END, 'page': CASE WHEN a.n > 0 THEN a.page ELSE x.p END, 'last': x.s, 'last_page': x.p, 'size': a.size + length(x.s) + CASE WHEN a.n > 0 THEN 1 ELSE 0 END, 'n': a.n + 1} END,
    {'out': []::STRUCT(t VARCHAR, p INTEGER)[], 'text': '', 'page': 0, 'last': '', 'last_page': 0, 'size': 0, 'n': 0}) AS f
  FROM sents GROUP BY ALL),
chunked AS (
  SELECT doc_id, section, i, c.t AS text, c.p AS page FROM (SELECT doc_id, section, unnest(whole) AS c, generate_subscripts(whole, 1) AS i
    FROM (SELECT doc_id, section, CASE WHEN f.n > 0 THEN f.out || [{'t': trim(f.text), 'p': f.page}] ELSE f.out END AS whole FROM folded)))""",
}
TEXTS = ("resume_texts", "content", "sents", "chunked")
SCORING = ("evidence", "requirements", "ranked_matches", "verdicts", "authentic", "scored")


def with_views(*names: str) -> str:
    """``WITH`` clause of the named views, in an order that suits their references."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
