"""Reading uploads and reports, writing reports and indexes.

Documents come through the ``binaryFile`` source, so any file system that Spark
reads will do; parsing one file is a small helper inside a task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.json import object_text
from ..functions.scores import fingerprint
from .buckets import BUCKET, BucketTable
from .shared import ship

SUFFIXES = {".pdf": ("application/pdf",), ".docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)}

REPORT = (
    "analysis_id long, candidate_id long, resume_id long, jd_id long, overall_score int, coverage_score int, experience_score int, project_score int, confidence_score int, quality_score int, "
    "summary string, requirements array<struct<requirement:string,category:string,status:string,matched_evidence:string,explanation:string,limitations:string,confidence:int,importance:string,weight:double>>, "
    "strengths array<string>, weaknesses array<string>, skill_relationships array<string>, missing_skills array<string>, learning_roadmap array<struct<skill:string,estimated_time:string,reason:string>>, "
    "interview_questions array<string>, recruiter_recommendation string, rejection_email string, "
    "authenticity struct<credibility_score:int,keyword_stuffing_risk:string,over_claimed_skills:array<string>,corroboration_ratio:double,explanation:string>, "
    "candidate_profile struct<name:string,title:string,total_years:double,seniority_level:string,required_years:double,seniority_fit:string,explanation:string>"
)
REQUIRED = ("analysis_id", "overall_score", "requirements", "summary")
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def file_kind(path: Column) -> Column:
    """The suffix of an accepted format, else null."""
    lower = F.lower(path)
    return F.when(lower.endswith(".pdf"), ".pdf").when(lower.endswith(".docx"), ".docx")


def split_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and refused rows of ``(filename, mime_type, ...)``: suffix and type must agree."""
    kind = file_kind(F.col("filename"))
    ok = F.coalesce((kind == ".pdf") & (F.col("mime_type") == SUFFIXES[".pdf"][0]) | (kind == ".docx") & (F.col("mime_type") == SUFFIXES[".docx"][0]), F.lit(False))
    return files.where(ok), files.where(~ok)


def stored_name(id_: Column, filename: Column) -> Column:
    return F.concat(id_.cast("string"), F.lit("_"), filename)


def docx_text(content: bytes) -> str:
    """Non-empty paragraphs, then table rows with their cells joined by a bar."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{WORDS}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{WORDS}t")).strip()
    lines = [words(p) for p in body.findall(f"{WORDS}p")]
    for row in (r for t in body.findall(f"{WORDS}tbl") for r in t.findall(f"{WORDS}tr")):
        lines.append(" | ".join(c for c in (words(cell) for cell in row.findall(f"{WORDS}tc")) if c))
    return "\n".join(x for x in lines if x)


def docx_bytes(paragraphs: list[str], rows: list[list[str]] = ()) -> bytes:
    """A document of plain paragraphs and one table; characters that XML can't hold become blanks."""
    clean = lambda t: escape(re.sub("[^\t\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", " ", t))
    p = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{clean(t)}</w:t></w:r></w:p>'
    table = "<w:tbl>" + "".join(f"<w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in row)}</w:tr>" for row in rows) + "</w:tbl>" if rows else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORDS[1:-1]}"><w:body>{"".join(map(p, paragraphs))}{table}</w:body></w:document>')
    return out.getvalue()


def docx_files(rows: DataFrame) -> DataFrame:
    """``(path, content)`` of ``rows (path, paragraphs array<string>, cells array<array<string>>)``, as ``binaryFile`` gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [docx_bytes(list(p), [list(r) for r in c]) for p, c in zip(batch["paragraphs"], batch["cells"])]
            yield pd.DataFrame({"path": batch["path"], "content": made})

    ship(rows.sparkSession)
    return rows.select("path", "paragraphs", "cells").mapInPandas(run, "path string, content binary")


def pdf_text(content: bytes) -> str:
    """Text of each page below its page mark; needs a PDF library."""
    from pypdf import PdfReader

    return "\n".join(f"--- PAGE {n} ---\n{page.extract_text() or ''}" for n, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1))


def parsed(files: DataFrame) -> DataFrame:
    """``(path, sha, text, error)`` of ``binaryFile`` rows; what can't be read has an error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for path, content in zip(batch["path"], batch["content"]):
                text = error = None
                try:
                    suffix = re.search(r"\.\w+$", path.lower())
                    if not suffix or suffix[0] not in SUFFIXES:
                        raise ValueError("unsupported format")
                    text = docx_text(content) if suffix[0] == ".docx" else pdf_text(content)
                except Exception as e:  # one unreadable upload is a row, not a failed job
                    error = f"{type(e).__name__}: {e}"[:500]
                texts.append(text), errors.append(error)
            yield pd.DataFrame({"path": batch["path"], "sha": batch["sha"], "text": texts, "error": errors})

    ship(files.sparkSession)
    return files.select("path", "content", fingerprint(F.col("content")).alias("sha")).mapInPandas(run, "path string, sha string, text string, error string")


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark.read.format("binaryFile").load(folder))


def scan_reports(spark: SparkSession, folder: str, multi_line: bool = False, glob: str = "*.json") -> DataFrame:
    """Stored reports with ``state``: ok, malformed (a required field is absent) or corrupt (no JSON of this shape).

    One report per line, or per file with ``multi_line``. A corrupt report keeps the id that its text names, if any.
    """
    raw = spark.read.format("json").schema(f"{REPORT}, _corrupt string").option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", glob).load(folder)
    corrupt = F.col("_corrupt").isNotNull()
    named = F.nullif(F.regexp_extract("_corrupt", r'"analysis_id"\s*:\s*(\d{1,18})', 1), F.lit("")).cast("long")
    state = F.when(corrupt, "corrupt").when(_complete(F.col), "ok").otherwise("malformed")
    return raw.withColumns({"state": state, "analysis_id": F.when(corrupt, named).otherwise(F.col("analysis_id"))}).drop("_corrupt")


def read_reports(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """Stored reports; corrupt files are skipped."""
    return scan_reports(spark, folder, multi_line).where("state <> 'corrupt'").drop("state")


def report_states(expected: DataFrame, scanned: DataFrame) -> DataFrame:
    """``expected (analysis_id)`` with its report's ``state``, missing where none is stored, and its fields if it is ok.

    Of several reports of an id a good one counts before a malformed and that before a corrupt one.
    """
    order = F.when(F.col("state") == "ok", 0).when(F.col("state") == "malformed", 1).otherwise(2)
    best = scanned.groupBy("analysis_id").agg(F.min_by(F.struct("state", "overall_score", "coverage_score", "summary"), F.struct(order, "overall_score", "summary")).alias("report"))
    field = lambda n: F.when(F.col("report.state") == "ok", F.col(f"report.{n}")).alias(n)
    return expected.join(best, "analysis_id", "left").select("analysis_id", F.coalesce("report.state", F.lit("missing")).alias("state"), *map(field, ("overall_score", "coverage_score", "summary")))


def _complete(field) -> Column:
    return reduce(lambda a, b: a & b, (field(n).isNotNull() for n in REQUIRED))


def parse_reports(rows: DataFrame, json: str = "body") -> DataFrame:
    """``rows`` with ``report`` and ``state``: ok, missing, or malformed (no JSON, or a required field is absent)."""
    out = rows.withColumn("report", F.from_json(json, REPORT))
    complete = F.col("report").isNotNull() & _complete(lambda n: F.col(f"report.{n}"))
    return out.withColumn("state", F.when(F.col(json).isNull(), "missing").when(complete, "ok").otherwise("malformed"))


def report_table(spark: SparkSession, folder: str, schema=REPORT, buckets: int = 64) -> BucketTable:
    """Reports as lines of JSON, in buckets by analysis."""
    return BucketTable(spark, folder, StructType.fromDDL(schema) if isinstance(schema, str) else schema, "analysis_id", buckets, "json")


def write_reports(reports: DataFrame, folder: str, buckets: int = 64) -> None:
    """A second report of an analysis replaces its first; the folder has ``buckets`` subfolders at most."""
    report_table(reports.sparkSession, folder, reports.schema, buckets).replace(reports)


def export_json(reports: DataFrame) -> DataFrame:
    """Pretty JSON of each report, and the MD5 of its bytes as an entity tag."""
    body = F.to_json(F.struct(*reports.columns), {"pretty": "true"})
    return reports.select("analysis_id", body.alias("body")).withColumn("etag", F.md5(F.col("body").cast("binary")))


def json_in_text(text: Column) -> Column:
    """The JSON object in a model's answer, null if there is none; ``functions.json`` says what is tolerated."""
    return object_text(text)


def index_table(spark: SparkSession, folder: str, schema: StructType, buckets: int = 64) -> BucketTable:
    """Vectors and chunks in buckets by resume, with the fingerprint of the source they were made from."""
    return BucketTable(spark, folder, schema, "resume_id", buckets)


def write_index(chunks: DataFrame, folder: str, buckets: int = 64) -> None:
    """The chunks of each resume in ``chunks`` replace those stored before."""
    index_table(chunks.sparkSession, folder, chunks.schema, buckets).replace(chunks)


def read_index(spark: SparkSession, folder: str, resume_id: int | None = None, buckets: int = 64) -> DataFrame:
    """All chunks, or those of one resume, for which only its bucket is read."""
    rows = spark.read.parquet(folder)
    if resume_id is None:
        return rows.drop(BUCKET)
    own = BucketTable(spark, folder, StructType(), "resume_id", buckets).bucket_of(F.lit(resume_id).cast("long"))
    return rows.where((F.col(BUCKET) == own) & (F.col("resume_id") == resume_id)).drop(BUCKET)


def write_ranking_csv(ranking: DataFrame, folder: str) -> None:
    flat = ranking.select(*(F.array_join(c, "; ").alias(c) if dict(ranking.dtypes)[c].startswith("array") else F.col(c) for c in ranking.columns))
    flat.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(folder)


def read_traits_csv(spark: SparkSession, path: str) -> DataFrame:
    traits = ", ".join(f"{t} double" for t in ("Extroversion", "Conscientiousness", "Openness", "Agreeableness", "Neuroticism"))
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(f"Resume_Text string, {traits}").csv(path)
