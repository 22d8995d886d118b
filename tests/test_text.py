"""Sections, sentences, chunks, requirements, priorities and profiles."""

import random
import unicodedata

import pytest
from assayer.operators import profile, requirements, structuring
from assayer.plans import catalog
from assayer.settings import DEFAULTS
from pyspark.sql import functions as F

RESUME = """Jane Q. Doe
Senior Data Engineer
jane@x.org
--- PAGE 1 ---
Experience:
Built ETL with Python. Used e.g. Airflow daily. Led B. Smith too.
- bullet without stop
--- page 2 ---
SKILLS
Python, SQL
Education
University of X"""


def column(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_sections_and_pages(spark):
    docs = spark.createDataFrame([(1, RESUME), (2, None), (3, "")], "doc_id long, text string")
    got = [tuple(r) for r in structuring.sections(docs).where("doc_id = 1").select(F.inline("lines")).collect()]
    assert got[0] == ("Summary", 1, "Jane Q. Doe")
    assert ("Experience", 1, "- bullet without stop") in got and ("Skills", 2, "Python, SQL") in got
    assert got[-1] == ("Education", 2, "University of X")
    assert all("PAGE" not in r[2] and r[2] != "SKILLS" for r in got)
    assert [r.n for r in structuring.sections(docs).orderBy("doc_id").select(F.size("lines").alias("n")).collect()][1:] == [0, 0]


def test_sentences(spark):
    cut = lambda t: column(spark, t, structuring.sentences)
    assert cut("One two. Three four! 5 six") == ["One two.", "Three four!", "5 six"]
    assert cut("Tools, e.g. Airflow. Next") == ["Tools, e.g. Airflow.", "Next"]
    assert cut("Met B. Smith. Then") == ["Met B. Smith.", "Then"]
    assert cut("- a bullet stays whole") == ["- a bullet stays whole"]
    assert cut("  ") == []


def plain_chunks(units, target=350, most=600, overlap=1):
    out, held, size = [], [], 0
    for s, page in units:
        more = len(s) + bool(held)
        if held and size >= target and size + more > most:
            out.append((" ".join(x for x, _ in held), held[0][1]))
            held = held[-overlap:]
            size = sum(len(x) + 1 for x, _ in held)
        held, size = [*held, (s, page)], size + more
        if size >= most:
            out.append((" ".join(x for x, _ in held), held[0][1]))
            held, size = [], 0
    return out + ([(" ".join(x for x, _ in held), held[0][1])] if held else [])


@pytest.mark.parametrize("seed", range(6))
def test_chunks_equal_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    units = [("x" * rnd.choice([20, 90, 340, 400, 900]), i // 3 + 1) for i in range(rnd.randrange(1, 25))]
    df = spark.createDataFrame([([{"sentence": s, "page": p} for s, p in units],)], "u array<struct<sentence:string,page:int>>")
    got = [tuple(r) for r in df.select(structuring.chunked(F.col("u")).alias("c")).first().c]
    assert got == plain_chunks(units)


def test_long_pair_exceeds_the_cap(spark):
    df = spark.createDataFrame([([{"sentence": "a" * 340, "page": 1}, {"sentence": "b" * 400, "page": 2}],)], "u array<struct<sentence:string,page:int>>")
    got = df.select(structuring.chunked(F.col("u")).alias("c")).first().c
    assert [(len(r.text), r.page) for r in got] == [(741, 1)]


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(7, 70, "f.pdf", RESUME), (8, 80, "g.pdf", None)], "resume_id long, candidate_id long, filename string, text string")
    rows = structuring.nodes(docs).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(len(rows)))
    assert [r.section for r in rows] == ["Summary", "Skills", "Experience", "Education"]
    assert {(r.candidate_id, r.filename, r.source_type) for r in rows} == {(70, "f.pdf", "resume")}


JD = """We are looking for a person.
Requirements:
- 5+ years building systems, 3 years leading
- Experience with Terraform, Snowflake and Apache Airflow
- Strong stakeholder management skills
Nice to have:
- Kubernetes experience
- Docker is required
"""


def test_requirements(spark):
    jobs = spark.createDataFrame([(1, JD), (2, None), (3, "")], "jd_id long, text string")
    found = [r.requirement for r in requirements.extract_requirements(jobs).collect()]
    low = [x.lower() for x in found]
    for want in ("terraform", "snowflake", "apache airflow", "kubernetes", "docker", "5+ years experience"):
        assert want in low, want
    assert "experience" not in low and "requirements" not in low
    assert low == sorted(low) and len(set(low)) == len(low) <= 40
    assert {r.jd_id for r in requirements.extract_requirements(jobs).select("jd_id").collect()} == {1}


def test_priorities(spark):
    jobs = spark.createDataFrame([(1, JD)], "jd_id long, text string")
    asked = spark.createDataFrame([(1, x) for x in ("terraform", "kubernetes", "docker", "cobol", "c++")], "jd_id long, requirement string")
    got = {r.requirement: (r.importance, r.weight) for r in requirements.priorities(asked, jobs).collect()}
    assert got == {"terraform": ("must", 1.0), "kubernetes": ("nice", 0.4), "docker": ("must", 1.0), "cobol": ("must", 1.0), "c++": ("must", 1.0)}


def test_terms(spark):
    has = lambda text, term: column(spark, text, lambda t: requirements.contains_term(t, F.lit(term)))
    assert has("knows C++ well", "c++") and not has("éc++", "c++") and has("a.b (go)", "go") and not has("golang", "go")
    assert has("odd \\Eterm here", "\\Eterm")
    tech = lambda t: column(spark, t, requirements.technical_specificity)
    assert tech("plain words only") == 0 and tech("python and AWS") == 40 and tech("python java aws docker k8s S3") == 100
    tokens = set(column(spark, "Uses PyTorch, SQL and node.js; Plain words", requirements.technical_tokens))
    assert {"pytorch", "sql", "node.js"} <= tokens and "plain" not in tokens


def test_term_match_takes_every_language(spark, tmp_path):
    texts = ["The C++ der", "xder derx", "éder", "der, QUE!", "DER_", "porqué que\u0301", "über der Token", "c++é idiot", "", None]
    rows = [(i, x, lang) for i, (x, lang) in enumerate((x, lang) for x in texts for lang in ("en", "de", "es", "fr", None))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in catalog.queries()["term_match"](spark, str(tmp_path)).collect()}
    wordy = lambda c: c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"

    def held(text, term):
        low = text.lower()
        return any(low.startswith(term, i) and not (i and wordy(low[i - 1])) and not wordy(low[i + len(term) : i + len(term) + 1] or " ") for i in range(len(low)))

    assert got == {i: tuple(None if x is None else held(x, w) for w in catalog.WATCHED) for i, x, _ in rows}


def test_candidate_skills_prefer_narrative(spark):
    rows = spark.createDataFrame([(1, 0, "SQL listed", "Skills"), (1, 1, "SQL at work", "Projects"), (1, 2, "SQL again", "Experience")], "analysis_id long, position int, chunk string, section string")
    got = {r.skill: (r.narrative, r.chunk) for r in requirements.candidate_skills(rows).collect()}
    assert got["sql"] == (True, "SQL at work")


def test_profile(spark):
    rows = spark.createDataFrame([("John Smith\nSenior Engineer\n7+ years of work", "needs 5 years"), ("x1\n2010 - 2016", ""), (None, None), ("Engineer\na@b.c\nMary-Ann O'Neil", "2 years")], "resume_text string, jd_text string")
    got = profile.profiles(rows).collect()
    assert (got[0].name, got[0].title, got[0].total_years, got[0].seniority_level, got[0].required_years, got[0].seniority_fit) == ("John Smith", "Senior Engineer", 7.0, "Senior", 5.0, "Exceeds")
    assert (got[1].total_years, got[1].seniority_fit) == (6.0, "Unknown")
    assert (got[2].name, got[2].seniority_level, got[2].seniority_fit) == (None, None, "Unknown")
    assert got[3].name == "Mary-Ann O'Neil" and DEFAULTS.chunk_max == 600


def test_a_section_of_many_sentences(spark):
    """200,000 sentences are one fold; the cost doesn't grow with the chunks made before."""
    import time

    began = time.time()
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.struct(F.concat(F.lit("Sentence number "), i.cast("string"), F.lit(" is here.")).alias("sentence"), F.floor(i / 1000).cast("int").alias("page"))).alias("u"))
    got = df.select(structuring.chunked(F.col("u")).alias("c")).first().c
    units = [(f"Sentence number {i} is here.", i // 1000) for i in range(1, 200_001)]
    assert [tuple(r) for r in got] == plain_chunks(units) and time.time() - began < 120


def test_cut_places_ask_for_the_mark_first(spark):
    """Same cuts as with the long test first, which was made at every character; behind marks alone it is cheap."""
    import random

    from assayer.operators import structuring
    from pyspark.sql import functions as F

    rng = random.Random(3)
    words = ["e.g.", "Dr.", "J.", "end.", "No", "why?", "Ok!", "3", "a", "u.s.", "x.y.", "Mr.", "ph.", "word"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", " ", "\t"]) for _ in range(30)),) for _ in range(200)]
    plain = F.split(structuring.stripped(F.col("line")), structuring._BEFORE + structuring._MARK + structuring._SPACE)
    got = spark.createDataFrame(rows, "line string").select(structuring.sentences(F.col("line")).alias("new"), plain.alias("plain")).collect()
    strip = lambda x: [y.strip() for y in x if y.strip()]
    assert all(len(r.new) == len(strip(r.plain)) for r in got) and sum(len(r.new) for r in got) > 400
    assert structuring._MARK + structuring._BEFORE in str(structuring.sentences(F.col("line"))).replace("\\\\", "\\")
