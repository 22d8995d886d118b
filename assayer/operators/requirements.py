"""Requirement phrases of job descriptions, their priority, and technical terms in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bound
from ..settings import DEFAULTS, Settings, taxonomy_terms
from .retrieval import ranked
from .structuring import stripped

# The grammar of job descriptions. The word lists and patterns decide which phrases count.
CUE = (
    "(?:experience|experienced|proficiency|proficient|expertise|expert|knowledge|knowledgeable|familiarity|familiar|skilled|"
    "competency|competence|understanding|fluency|fluent|versed|hands-on|background|ability|exposure)"
)
WORD = r"[A-Za-z][A-Za-z0-9+#./-]*"
CUE_AFTER = rf"(?i){CUE}\s+(?:with|in|of|using|on|across|w/)\s+((?:{WORD}[\s,/&]+){{0,6}}{WORD})"
CUE_BEFORE = rf"(?i)((?:{WORD}\s+){{0,2}}{WORD})\s+{CUE}\b"
CAPITALISED = r"\b([A-Z][A-Za-z0-9+#./-]*(?:\s+(?:&\s+)?[A-Z][A-Za-z0-9+#./-]*){0,3})\b"
YEARS = r"(?i)(\d{1,9})\s*\+?\s*years?"
SPLIT = r"(?i)\s*(?:,|/|&|\band\b|\bor\b)\s*"
LINE_HEADER = r"(?i)^\s*(requirements|qualifications|skills|responsibilities|what you.ll (need|do)|must have|nice to have|tech stack)\b"
BULLET = r"^\s*(?:[-*•▪◦]|\d+[.)])\s+"
NICE_HEADER = r"(?i)^\s*(nice[\s-]*to[\s-]*have|preferred|bonus|good[\s-]*to[\s-]*have|desirable|pluses?|optional|nice)\b"
MUST_HEADER = r"(?i)^\s*(requirements?|required|must[\s-]*have|qualifications|minimum qualifications|what you.ll need|essential|responsibilities|you have)\b"
NICE_CUE = r"(?i)\b(nice[\s-]*to[\s-]*have|preferred|preferable|bonus|a plus|good[\s-]*to[\s-]*have|desirable|desired|optional|advantageous|ideally|would be (a )?(plus|great|nice))\b"
MUST_CUE = r"(?i)\b(must[\s-]*have|must|required|require|essential|mandatory|minimum|need to have)\b"
TECHNICAL = r"[A-Za-z]+[A-Z0-9]|[A-Z]{2,}|[A-Za-z]*[0-9][A-Za-z0-9]*|[A-Za-z][A-Za-z0-9]*[+#/.][A-Za-z0-9+#/.]*"
# The same with words of small letters alone taken whole, so that none of their letters is tried as a start.
_PLAIN_OR_TECHNICAL = rf"[a-z]++(?![A-Za-z0-9+#/.])|({TECHNICAL})"
STOP = [
    "a", "an", "the", "and", "or", "to", "for", "of", "in", "on", "with", "as", "is", "are", "be", "we", "you", "our", "your", "their", "this",
    "that", "these", "those", "it", "its", "who", "will", "can", "must", "should", "have", "has", "nice", "plus", "etc", "strong", "good", "great",
    "excellent", "solid", "deep", "hands", "proven", "exposure", "familiarity", "familiar", "proficiency", "proficient", "expertise", "expert",
    "competency", "competence", "fluency", "fluent", "versed", "experienced", "knowledgeable", "skilled", "background", "years", "year", "role",
    "team", "teams", "company", "candidate", "candidates", "requirements", "responsibilities", "qualifications", "skills", "skill", "ability",
    "experience", "knowledge", "understanding", "work", "working", "using", "looking", "preferred", "required", "related", "similar", "field",
    "degree", "software", "engineer", "engineers", "developer", "developers", "architect", "analyst", "manager", "designer", "scientist",
    "administrator", "specialist", "lead", "intern", "consultant", "senior", "junior", "mid", "level", "position", "job",
]
MOST_WORDS, MOST_PHRASES = 4, 40


def contains_term(text: Column, term: Column) -> Column:
    """Whole-term, case-insensitive, with the term taken literally; word characters are Unicode's."""
    literal = F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.regexp_like(text, F.concat(F.lit(r"(?i)(?U)(?<!\w)\Q"), literal, F.lit(r"\E(?!\w)")))


def terms_in(text: Column, terms: list[str] | None = None) -> Column:
    """The given terms (the taxonomy's by default) that a text holds, in the given order.

    Each term is a pattern of its own that is known when the plan is made, and so compiled once;
    it is tried on texts that hold the term's letters, in any case (a dotted capital I counts as i).
    """
    known = taxonomy_terms() if terms is None else terms
    folded = F.lower(F.upper(F.replace(text, F.lit("\u0130"), F.lit("i"))))
    near = lambda whole: F.array(*[F.contains(whole, F.lit(t.upper().lower())) for t in known])
    maybe = bound(folded, near)
    return bound(maybe, lambda m: F.array_compact(F.array(*[F.when(m[i] & contains_term(text, F.lit(t)), t) for i, t in enumerate(known)])))


def term_documents(docs: DataFrame, text: str = "text", terms: list[str] | None = None) -> DataFrame:
    """``(place, term, documents)``: every given term (the taxonomy's by default), in order, and how many rows hold it."""
    known = taxonomy_terms() if terms is None else terms
    held = docs.select(F.explode(terms_in(F.col(text), known)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    listed = docs.sparkSession.createDataFrame(list(enumerate(known, 1)), "place long, term string")
    return listed.join(held, "term", "left").select("place", "term", F.coalesce("documents", F.lit(0)).alias("documents"))


def technical_specificity(text: Column, terms: list[str] | None = None) -> Column:
    """20 points for each distinct technical term or technical-looking token, at most 100."""
    shaped = F.filter(F.regexp_extract_all(text, F.lit(_PLAIN_OR_TECHNICAL), 1), lambda t: t != "")
    shaped = F.transform(shaped, lambda t: F.regexp_replace(F.lower(t), r"^[+#/.]+|[+#/.]+$", ""))
    hits = F.array_union(terms_in(F.lower(text), terms), F.filter(shaped, lambda t: F.length(t) >= 2))
    return F.least(F.lit(20) * F.size(hits), F.lit(100))


def technical_tokens(chunk: Column, terms: list[str] | None = None) -> Column:
    """Lower-cased skill tokens: known terms, and whole words with a digit, +#/., all capitals or inner capitals."""
    words = F.transform(F.regexp_extract_all(chunk, F.lit(WORD), 0), lambda w: F.regexp_replace(w, r"^[+#/.]+|[+#/.]+$", ""))
    inner = lambda w: F.substring(w, 2, 1 << 30)
    looks = lambda w: (F.length(w) >= 2) & (w.rlike(r"[0-9+#/.]") | ((F.upper(w) == w) & (F.lower(w) != w)) | (inner(w) != F.lower(inner(w))))
    return F.array_union(terms_in(F.lower(chunk), terms), F.transform(F.filter(words, looks), F.lower))


def candidate_skills(matches: DataFrame) -> DataFrame:
    """``(analysis_id, skill, narrative, chunk, section)``: each skill's first narrative mention, else its first."""
    # A chunk answers several requirements; its first row is that of all its skills. Rows are dealt by analysis once, for both steps.
    rows = matches.select("analysis_id", "position", "chunk", "section", F.coalesce(F.col("section").isin("Experience", "Projects"), F.lit(False)).alias("narrative")).repartition("analysis_id")
    rows = ranked(rows, ["analysis_id", "chunk"], [F.desc("narrative"), F.asc("position"), F.asc("section")], "r", 1)
    rows = rows.select("analysis_id", "position", "chunk", "section", "narrative", F.explode(F.array_distinct(technical_tokens(F.coalesce("chunk", F.lit(""))))).alias("skill"))
    return ranked(rows, ["analysis_id", "skill"], [F.desc("narrative"), F.asc("position"), F.asc("chunk"), F.asc("section")], "r", 1).select("analysis_id", "skill", "narrative", "chunk", "section")


def content_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), stripped), lambda x: x != "")


def requirement_lines(text: Column) -> Column:
    """Lines that state requirements: bullets, lines with a cue, and all below the first heading."""
    lines = F.transform(content_lines(text), lambda x, i: F.struct(x.alias("line"), i.alias("at"), x.rlike(LINE_HEADER).alias("head")))
    first = F.coalesce(F.array_min(F.transform(F.filter(lines, lambda r: r["head"]), lambda r: r["at"])), F.lit(1 << 30))
    return F.transform(F.filter(lines, lambda r: ~r["head"] & ((r["at"] > first) | r["line"].rlike(BULLET) | r["line"].rlike(f"(?i){CUE}"))), lambda r: r["line"])


def clean_phrase(raw: Column) -> Column:
    """A phrase without stop words at its ends, of four words at most; empty if only filler is left."""
    bare = lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", "")
    stops = F.array(*[F.lit(w) for w in STOP])
    words = F.transform(F.filter(F.split(F.trim(raw), r"\s+"), lambda w: w != ""), lambda w, i: F.struct(i.alias("i"), w.alias("w"), F.array_contains(stops, bare(w)).alias("stop")))
    places = F.transform(F.filter(words, lambda x: ~x["stop"]), lambda x: x["i"])
    first, last = F.array_min(places), F.array_max(places)
    kept = F.transform(F.slice(words, first + 1, F.least(last - first + 1, F.lit(MOST_WORDS))), lambda x: x["w"])
    phrase = F.regexp_replace(F.array_join(kept, " "), r"^[ \-,/&]+|[ \-,/&]+$", "")
    means = F.exists(F.split(phrase, r"\s+"), lambda w: ~F.array_contains(stops, bare(w)) & (F.length(bare(w)) >= 2))
    return F.when(first.isNotNull() & means, phrase).otherwise("")


def extract_requirements(jobs: DataFrame, id_col: str = "jd_id", text_col: str = "text", terms: list[str] | None = None) -> DataFrame:
    """``(jd_id, requirement)``: known terms first, then phrases after and before cues, then
    capitalised phrases, then the years asked for; the first 40 by that order, once each
    whatever their case, less single words that are part of a longer phrase kept. A
    job's phrases come in order of their lower-cased form."""
    known = taxonomy_terms() if terms is None else terms
    lines = jobs.select(F.col(id_col).alias("jd_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), requirement_lines(F.col(text_col)).alias("lines"))
    joined = F.array_join("lines", "\n")
    after = F.flatten(F.transform(F.regexp_extract_all(joined, F.lit(CUE_AFTER), 1), lambda x: F.split(x, SPLIT)))
    before = F.regexp_extract_all(joined, F.lit(CUE_BEFORE), 1)
    capital = F.flatten(F.transform("lines", lambda x: F.regexp_extract_all(x, F.lit(CAPITALISED), 1)))
    years = F.array_max(F.transform(F.regexp_extract_all("text", F.lit(YEARS), 1), lambda x: x.cast("long")))
    asked = F.when(years.isNotNull(), F.array(F.concat(years.cast("string"), F.lit("+ years experience")))).otherwise(F.array().cast("array<string>"))
    phrases = F.transform(F.concat(after, before, capital), clean_phrase)
    rows = lines.select("jd_id", F.posexplode(F.concat(terms_in(F.col("text"), known), phrases, asked)).alias("at", "display")).where("display <> ''").withColumn("key", F.lower("display"))
    once = rows.groupBy("jd_id", "key").agg(F.min(F.struct("at", "display")).alias("first")).select("jd_id", "key", "first.*")
    once = ranked(once, ["jd_id"], [F.asc("at")], "r", MOST_PHRASES)
    whole = once.groupBy("jd_id").agg(F.collect_list(F.struct("key", "display")).alias("found"))  # at most 40 each
    several = F.filter("found", lambda x: F.size(F.split(x["display"], " ")) > 1)
    parts = F.flatten(F.transform(several, lambda x: F.split(x["display"], " ")))
    keep = lambda x: (F.size(F.split(x["display"], " ")) > 1) | F.array_contains(F.array(*[F.lit(t) for t in known]), x["key"]) | ~F.array_contains(F.col("parts"), x["key"])
    return whole.select("jd_id", "found", parts.alias("parts")).select("jd_id", F.inline(F.array_sort(F.filter("found", keep)))).select("jd_id", F.col("display").alias("requirement"))


def line_priorities(text: Column) -> Column:
    """``array<(line, priority)>``: a cue in the line, else the last heading above or in it, else must."""
    lines = F.transform(content_lines(text), lambda x, i: F.struct(x.alias("line"), i.alias("at"), F.when(x.rlike(NICE_HEADER), "nice").when(x.rlike(MUST_HEADER), "must").alias("head"), F.when(x.rlike(NICE_CUE), "nice").when(x.rlike(MUST_CUE), "must").alias("cue")))

    def add(out: Column, r: Column) -> Column:
        context = F.coalesce(r["head"], F.try_element_at(out, F.lit(-1))["context"], F.lit("must"))
        return F.concat(out, F.array(F.struct(r["line"].alias("line"), F.coalesce(r["cue"], context).alias("priority"), context.alias("context"))))

    return F.aggregate(lines, F.array().cast("array<struct<line:string,priority:string,context:string>>"), add)


def priorities(requirements: DataFrame, jobs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``(jd_id, requirement, importance, weight)``: nice only if every line that names it is."""
    lines = jobs.select("jd_id", F.inline(line_priorities(F.col("text")))).drop("context")
    named = requirements.select("jd_id", "requirement").join(lines, "jd_id").where(contains_term(F.col("line"), F.col("requirement")))
    seen = named.groupBy("jd_id", "requirement").agg(F.bool_and(F.col("priority") == "nice").alias("nice"))
    out = requirements.select("jd_id", "requirement").join(seen, ["jd_id", "requirement"], "left")
    nice = F.coalesce("nice", F.lit(False))
    return out.select("jd_id", "requirement", F.when(nice, "nice").otherwise("must").alias("importance"), F.when(nice, F.lit(s.weight_nice)).otherwise(F.lit(s.weight_must)).alias("weight"))


