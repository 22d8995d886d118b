"""From documents to leaderboards: one lazy plan over all pairs of resumes and jobs.

Resumes are structured and encoded once, job descriptions once; evidence is a
join on the job's requirements per resume, and every later step groups by
analysis, so a pair is never handled alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.vectors import dot, hashed_vector
from ..operators import dml, requirements, retrieval, scoring, structuring
from ..settings import DEFAULTS, TAXONOMY, Settings
from ..sources.shared import materialise

Encoder = Callable[[Column], Column]


def default_encoder(text: Column) -> Column:
    return hashed_vector(retrieval.tokens(text))


def ingest(documents: DataFrame, index: DataFrame, encode: Encoder = default_encoder, s: Settings = DEFAULTS) -> DataFrame:
    """Index rows of documents ``(resume_id, candidate_id, filename, text)`` whose content the index
    ``(resume_id, sha)`` doesn't hold yet: chunks with metadata, vector and fingerprint."""
    hashed = documents.withColumn("sha", S.fingerprint(F.col("text")))
    fresh = documents.join(dml.stale_sources(hashed.select("resume_id", "sha"), index).select("resume_id"), "resume_id", "left_semi")
    nodes = structuring.nodes(fresh, s)
    # Chunks of a resume that repeat a text are encoded once; they lie in one place already.
    rest = [c for c in nodes.columns if c not in ("resume_id", "text")]
    once = nodes.groupBy("resume_id", "text").agg(F.collect_list(F.struct(*rest)).alias("same"))
    told = once.select("*", encode(F.col("text")).alias("embedding"), requirements.technical_specificity(F.col("text")).alias("technical"))
    whole = told.select("resume_id", "text", "embedding", "technical", F.inline("same")).join(hashed.select("resume_id", "sha"), "resume_id")
    return whole.select(*nodes.columns, "sha", "embedding", "technical")


def job_requirements(jobs: DataFrame, encode: Encoder = default_encoder, terms: list[str] | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """``(jd_id, requirement, importance, weight, position, vector)`` of jobs ``(jd_id, text)``."""
    found = requirements.priorities(requirements.extract_requirements(jobs, "jd_id", "text", terms), jobs, s)
    placed = retrieval.ranked(found, ["jd_id"], [F.lower("requirement").asc(), F.asc("requirement")], "position")
    return placed.withColumn("vector", encode(F.col("requirement")))


def evidence(pairs: DataFrame, chunks: DataFrame, asked: DataFrame, top_k: int = 3, s: Settings = DEFAULTS) -> DataFrame:
    """Matches of each analysis ``(analysis_id, resume_id, jd_id)``: chunks of its resume over the
    floor, one per text, the ``top_k`` best by fused rank of confidence and BM25 within the resume.

    The join is by resume and by job; its size is requirements times chunks of a resume. Every step
    groups by the resume first, so what that join makes is never dealt out again, and texts meet the
    evidence that is left at the end.
    """
    key, item = ("resume_id", *scoring.KEY), ("resume_id", "chunk_id")
    wanted = pairs.join(asked, "jd_id").select("analysis_id", "resume_id", "requirement", "vector")
    trimmed = F.trim("text")
    twin = F.min("chunk_id").over(Window.partitionBy("resume_id", trimmed))  # the same for chunks of one text
    rated = chunks.select(*item, "section", "technical", "embedding", twin.alias("twin"), S.density_score(trimmed).alias("density"))
    scored = wanted.join(rated, "resume_id").select(*key, "chunk_id", "section", "technical", "twin", "density", dot(F.col("vector"), F.col("embedding")).alias("cosine"))
    pool = retrieval.ranked(scored, [*key], [F.desc("cosine"), F.asc("chunk_id")], "position", retrieval.candidate_pool(top_k))
    pool = retrieval.ranked(pool, [*key, "twin"], [F.asc("position")], "copy", 1).where(S.round_half_up(F.col("cosine"), 3) >= s.similarity_floor)
    phrases = wanted.select("resume_id", F.col("requirement").alias("query_id"), F.col("requirement").alias("text")).distinct()
    words = retrieval.bm25(phrases, chunks.select("resume_id", F.col("chunk_id").alias("doc_id"), "text"), s, by=("resume_id",))
    words = words.select("resume_id", F.col("query_id").alias("requirement"), F.col("doc_id").alias("chunk_id"), F.col("score").alias("sparse"))
    blend = S.confidence(F.col("cosine"), S.section_score(F.col("section")), F.col("density"), F.col("technical"), s)
    both = pool.join(words, ["resume_id", "requirement", "chunk_id"], "left").withColumn("confidence", blend)
    rows = both.withColumns({"dense": F.col("confidence"), "sparse": F.round(F.coalesce("sparse", S.d(0)), 9)})
    fused = retrieval.fuse(rows, s, key).where(F.col("rank") <= top_k)
    told = fused.join(chunks.select(*item, trimmed.alias("chunk")), [*item])
    return told.select(*scoring.KEY, "chunk", "section", S.round_half_up(F.col("cosine"), 3).alias("score"), "confidence", F.col("rank").alias("position"))


def categorised(rows: DataFrame, name: str, encode: Encoder = default_encoder, s: Settings = DEFAULTS) -> DataFrame:
    """``rows`` with ``vector`` and ``category`` of a text column: the taxonomy's nearest category, or the fallback."""
    known = rows.sparkSession.createDataFrame([(c, t) for c, terms in TAXONOMY.items() for t in terms], "category string, term string")
    middle = retrieval.centroids(known.select("category", encode(F.col("term")).alias("embedding")), "category")
    few = [{"category": r["category"], "centroid": list(r["centroid"])} for r in middle.orderBy("category").collect()]  # one row per category of the taxonomy
    packed = F.from_json(F.lit(json.dumps(few)), "array<struct<category:string,centroid:array<double>>>")
    # The lambda binds the vector, so that the encoder's expression isn't copied into each use of it.
    both = F.transform(F.array(encode(F.col(name))), lambda v: F.struct(v.alias("vector"), retrieval.category_of(v, packed, s).alias("category")))
    return rows.withColumn("__both", both[0]).withColumns({"vector": F.col("__both.vector"), "category": F.col("__both.category")}).drop("__both")


def relations(wanted: DataFrame, skills: DataFrame, encode: Encoder = default_encoder, s: Settings = DEFAULTS) -> DataFrame:
    """What ties each requirement ``(analysis_id, requirement)`` to the candidate's ``skills``: as
    ``retrieval.related_skills``, where a skill is only *related* within one category of the taxonomy.
    ``wanted`` may bring each requirement's ``vector`` and ``category`` along."""
    left = wanted if "category" in wanted.columns else categorised(wanted, "requirement", encode, s)
    left = left.select(F.col("analysis_id").alias("owner"), F.col("requirement").alias("name"), "vector", "category")
    right = categorised(skills.select(F.col("analysis_id").alias("owner"), F.col("skill").alias("name"), "narrative", F.col("chunk").alias("skill_chunk")), "name", encode, s)
    found = retrieval.related_skills(left, right, s, carry=("narrative", "skill_chunk"))
    return found.withColumnsRenamed({"owner": "analysis_id", "name": "requirement"})


def evaluate(pairs: DataFrame, chunks: DataFrame, asked: DataFrame, encode: Encoder = default_encoder, s: Settings = DEFAULTS) -> DataFrame:
    """Verdicts of all analyses, with equivalent and related skills of each candidate taken into account.

    Evidence is used twice, for skills and for verdicts, and written in between; write ``chunks`` and ``asked`` to tables first.
    """
    found = materialise(evidence(pairs, chunks, asked, s=s), "evidence")
    wanted = pairs.join(asked, "jd_id").select("analysis_id", "requirement", "importance", "weight", "position")
    skills = requirements.candidate_skills(found)
    kinds = pairs.join(categorised(asked, "requirement", encode, s), "jd_id").select("analysis_id", "requirement", "vector", "category")  # a job's, not a pair's
    return scoring.verdicts(wanted, found.drop("position"), relations(kinds, skills, encode, s), s)


def rank(pairs: DataFrame, verdicts: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Leaderboard of each job: analyses without verdicts come last with an error."""
    scores = scoring.sub_scores(verdicts, s)
    rows = pairs.join(scores.select("analysis_id", "overall_score"), "analysis_id", "left")
    return scoring.leaderboard(rows.select("jd_id", "resume_id", F.col("analysis_id").alias("position"), "overall_score", F.when(F.col("overall_score").isNull(), "no requirement could be judged").alias("error")))


def leaderboards(documents: DataFrame, jobs: DataFrame, pairs: DataFrame, encode: Encoder = default_encoder, terms: list[str] | None = None, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """``(ranking, scores)`` of all ``pairs (analysis_id, resume_id, jd_id)``, from documents ``(resume_id, candidate_id,
    filename, text)`` and jobs ``(jd_id, text)`` alone.

    Chunks, requirements, evidence and verdicts are each written once, as several steps read them.
    """
    nothing = documents.sparkSession.createDataFrame([], "resume_id long, sha string")
    chunks = materialise(ingest(documents, nothing, encode, s), "chunks")
    asked = materialise(job_requirements(jobs, encode, terms, s), "asked")
    verdicts = materialise(evaluate(pairs, chunks, asked, encode, s), "verdicts")
    return rank(pairs, verdicts, s), scoring.sub_scores(verdicts, s)
