"""Documents to pages, sections, sentences and overlapping chunks.

Lines are rows: each is classified once, and a window over its own document
carries the last heading and page mark down. That is one shuffle, by document,
which numbering and chunking reuse; work is linear in lines. Sentences and chunks
are made inside rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from .retrieval import ranked

SECTIONS = ("Summary", "Skills", "Experience", "Projects", "Education", "Certifications")
# The headings that open a section, and words after which a full stop ends no sentence.
HEADINGS = {
    "Skills": "skills|technical skills|key skills|core competencies|technologies|skills & tools|expertise|specialties|tools",
    "Experience": "experience|professional experience|work experience|employment history|work history|career history|employment|background",
    "Projects": "projects|personal projects|selected projects|academic projects|key projects|development projects",
    "Education": "education|academic background|academic history|degrees|academic credentials|university",
    "Certifications": "certifications|certificates|courses|licenses|training|professional development",
}
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "mr.", "ms.", "mrs.", "dr.", "sr.", "jr.", "ph.", "st.", "no.", "inc.", "ltd.", "co.", "u.s.", "u.k.")
PAGE = r"(?i)^---\s*PAGE\s+(\d{1,9})\s*---$"
STRIP = r"^\s+|\s+$"


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, STRIP, "")


def heading(line: Column) -> Column:
    """The section that a short line opens, or null."""
    clean = F.trim(F.lower(F.regexp_replace(line, r"(?U)[^\w\s&]", "")))
    found = F.lit(None).cast("string")
    for name, words in reversed(HEADINGS.items()):
        found = F.when(clean.isin(words.split("|")), name).otherwise(found)
    return F.when(F.length(line) < 40, found)


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line with the last heading and page mark above it, and whether it is content."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    # Numbered within the id, so that whole texts are dealt by id, once for all later steps, and not if they are already.
    rows = ranked(rows, ["doc_id"], [F.asc("row")], "doc_row")
    cut = rows.select("doc_id", "doc_row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "raw"))
    lines = cut.select("doc_id", "doc_row", "at", stripped(F.col("raw")).alias("line"))
    mark = F.when(F.col("line").startswith("---"), F.nullif(F.regexp_extract("line", PAGE, 1), F.lit("")).cast("int"))
    classed = lines.withColumn("mark", mark).withColumn("head", F.when(F.col("mark").isNull(), heading(F.col("line"))))
    above = Window.partitionBy("doc_id", "doc_row").orderBy("at")
    placed = classed.withColumns({"section": F.coalesce(F.last("head", True).over(above), F.lit("Summary")), "page": F.coalesce(F.last("mark", True).over(above), F.lit(1))})
    return placed.withColumn("content", F.expr("head IS NULL AND mark IS NULL AND line <> ''"))


def section_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, doc_row, at, section, page, line)``: content lines with the last heading and page mark above them.

    ``at`` orders the lines of a document, ``doc_row`` tells rows apart that repeat
    an id. Blank lines, headings and marks are no content; null texts have no lines.
    """
    return _placed(docs, id_col, text_col).where("content").select("doc_id", "doc_row", "at", "section", "page", "line")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lines array<(section, page, line)>)`` per row of ``docs``: its content lines in order, maybe none."""
    rows = F.array_sort(F.collect_list(F.when(F.col("content"), F.struct("at", "section", "page", "line"))))
    whole = _placed(docs, id_col, text_col).groupBy("doc_id", "doc_row").agg(rows.alias("rows"))
    return whole.select("doc_id", F.transform("rows", lambda r: F.struct(r["section"].alias("section"), r["page"].alias("page"), r["line"].alias("line"))).alias("lines"))


# A place to cut: not behind an abbreviation or an initial that is a word of its own. The mark is asked for
# first, so that the longer test is made behind marks alone.
_BEFORE = r"(?i)(?<!(?:^|\s)(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r"|[a-z\u212A]\.))(?-i)"
_MARK = r"(?<=[.!?])"
_SPACE = r"\s+(?=[A-Z0-9])"


def sentences(line: Column) -> Column:
    """Sentences of a line: cut after . ! ? before a capital or digit, but not after an
    abbreviation or an initial. A line without such a place stays whole."""
    pieces = F.transform(F.split(stripped(line), _MARK + _BEFORE + _SPACE), lambda x: F.regexp_replace(stripped(x), _MARK + _SPACE, " "))
    return F.filter(pieces, lambda x: x != "")


def chunked(units: Column, s: Settings = DEFAULTS) -> Column:
    """``array<(text, page)>`` of ``array<(sentence, page)>``.

    A chunk of at least the target length closes before a sentence that would push
    it past the maximum, and its last sentences open the next one; a chunk that
    reaches the maximum closes with no overlap. The length is counted as it is
    added up, so after an overlap one space counts twice. Sentences are folded into
    the numbers that chunks begin and end at, so the cost grows with their number.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("first"), F.lit(0).alias("length"), F.array().cast("array<int>").alias("recent"), F.lit("").alias("cuts"))
    sizes = F.transform(units, lambda u: F.length(u["sentence"]))

    def add(state: Column, size: Column) -> Column:
        """Only the numbers of a chunk's first and last sentence are kept, one entry for each chunk that closes."""
        at, held = state["at"] + 1, state["at"] + 1 - state["first"]
        more = size + F.when(held > 0, 1).otherwise(0)
        full = (held > 0) & (state["length"] >= s.chunk_target) & (state["length"] + more > s.chunk_max)
        cut = lambda first, last: F.concat(first.cast("string"), F.lit(":"), last.cast("string"), F.lit(","))
        kept = F.slice(state["recent"], F.greatest(F.lit(1), F.size(state["recent"]) - F.least(held, F.lit(s.chunk_overlap)) + 1), F.least(held, F.lit(s.chunk_overlap))) if s.chunk_overlap else F.array().cast("array<int>")
        length = more + F.when(full, F.aggregate(kept, F.lit(0), lambda a, x: a + x + 1)).otherwise(state["length"])
        first = F.when(full, at - F.size(kept)).otherwise(state["first"])
        done = length >= s.chunk_max
        closed = F.when(full, F.concat(state["cuts"], cut(state["first"], state["at"]))).otherwise(state["cuts"])
        return F.struct(
            at.alias("at"), F.when(done, at + 1).otherwise(first).alias("first"), F.when(done, 0).otherwise(length).alias("length"),
            F.slice(F.concat(state["recent"], F.array(size)), F.greatest(F.lit(1), F.size(state["recent"]) + 2 - max(1, s.chunk_overlap)), F.lit(max(1, s.chunk_overlap))).alias("recent"),
            F.when(done, F.concat(closed, cut(first, at))).otherwise(closed).alias("cuts"),
        )

    def ranges(state: Column) -> Column:
        rest = F.when(state["at"] >= state["first"], F.concat(state["first"].cast("string"), F.lit(":"), state["at"].cast("string"))).otherwise("")
        pairs = F.filter(F.split(F.concat(state["cuts"], rest), ","), lambda x: x != "")
        return F.transform(pairs, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("int").alias("first"), F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("last")))

    text = lambda r: F.trim(F.array_join(F.transform(F.slice(units, r["first"], r["last"] - r["first"] + 1), lambda u: u["sentence"]), " "))
    made = F.transform(F.aggregate(sizes, start, add, ranges), lambda r: F.struct(text(r).alias("text"), F.element_at(units, r["first"])["page"].alias("page")))
    return F.filter(made, lambda c: c["text"] != "")


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = DEFAULTS) -> DataFrame:
    """``(doc_id, chunk_id, section, page, text)``; chunk ids run from 0 in section order.

    Each section of a document is chunked by itself, and rows that repeat an id
    each for themselves, numbered one after another.
    """
    lines = section_lines(docs, id_col, text_col).withColumn("sentences", sentences(F.col("line")))
    rows = F.array_sort(F.collect_list(F.struct("at", "page", "sentences")))
    units = F.flatten(F.transform(F.col("rows"), lambda r: F.transform(r["sentences"], lambda x: F.struct(x.alias("sentence"), r["page"].alias("page")))))
    whole = lines.groupBy("doc_id", "doc_row", "section").agg(rows.alias("rows")).select("doc_id", "doc_row", "section", units.alias("units"))
    cut = whole.select("doc_id", "doc_row", F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).alias("ord"), "section", F.posexplode(chunked(F.col("units"), s)).alias("seq", "chunk"))
    numbered = ranked(cut, ["doc_id"], [F.asc("doc_row"), F.asc("ord"), F.asc("seq")], "n")
    return numbered.select("doc_id", (F.col("n") - 1).alias("chunk_id"), "section", F.col("chunk.page").alias("page"), F.col("chunk.text").alias("text"))


def nodes(documents: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Chunks with all metadata of ``documents (resume_id, candidate_id, filename, text)``."""
    cut = chunks(documents, "resume_id", "text", s).withColumnRenamed("doc_id", "resume_id")
    return cut.join(documents.select("resume_id", "candidate_id", "filename"), "resume_id").withColumn("source_type", F.lit("resume"))
