"""The whole chain from documents to a leaderboard, and the views on it."""

from dataclasses import replace

from assayer.operators import scoring, search, traits
from assayer.plans import evaluation
from assayer.settings import DEFAULTS, TAXONOMY
from pyspark.sql import functions as F

GOOD = "Ann Lee\nExperience\nBuilt python services with docker on AWS for six years, and python tooling for many teams across the whole company.\nProjects\nA docker based python deployment."
POOR = "Bob Ray\nSkills\nCooking, gardening"
JD = "Requirements:\n- Python experience\n- Docker\nNice to have:\n- Kubernetes"


def test_documents_to_leaderboard(spark):
    s = replace(DEFAULTS, similarity_floor=0.05)
    docs = spark.createDataFrame([(1, 1, "a.pdf", GOOD), (2, 2, "b.pdf", POOR), (3, 3, "c.pdf", None)], "resume_id long, candidate_id long, filename string, text string")
    index = spark.createDataFrame([], "resume_id long, sha string")
    chunks = evaluation.ingest(docs, index, s=s).cache()
    assert {r.resume_id for r in chunks.collect()} == {1, 2}
    again = evaluation.ingest(docs, chunks.select("resume_id", "sha").distinct(), s=s)
    assert again.count() == 0
    asked = evaluation.job_requirements(spark.createDataFrame([(9, JD)], "jd_id long, text string"), s=s).cache()
    assert {"python", "docker", "kubernetes"} <= {r.requirement.lower() for r in asked.collect()}
    pairs = spark.createDataFrame([(100 + i, i, 9) for i in (1, 2, 3)], "analysis_id long, resume_id long, jd_id long")
    verdicts = evaluation.evaluate(pairs, chunks, asked, s=s).cache()
    got = {(r.analysis_id, r.requirement.lower()): r for r in verdicts.collect()}
    assert got[101, "python"].status in ("Matched", "Partial") and got[101, "python"].demonstrated
    assert got[101, "kubernetes"].importance == "nice" and got[103, "python"].status == "Missing"
    board = evaluation.rank(pairs, verdicts, s)
    assert board.orderBy("rank").first().resume_id == 1
    reports = scoring.reports(verdicts, s)
    answers = scoring.interview(reports, spark.createDataFrame([(101, 1, "What about Python?")], "analysis_id long, question_id int, question string")).collect()
    assert {(a.analysis_id, a.question_id) for a in answers} == {(101, 1), (102, 0), (103, 0)}
    assert scoring.rendered_evidence(evaluation.evidence(pairs, chunks, asked, s=s)).where("evidence <> ''").count() > 0
    view = scoring.requirement_view(verdicts).where("analysis_id = 101").orderBy("place").collect()
    assert [r.importance for r in view] == sorted(r.importance for r in view)


def test_related_needs_one_category_and_equivalent_does_not(spark):
    """Vectors are set by hand: one axis per category, and one that azure and sql share across categories."""
    axes = {c: i for i, c in enumerate(TAXONOMY)}
    unit = lambda **w: [w.get("cloud", 0.0) if i == axes["Cloud & DevOps"] else w.get("db", 0.0) if i == axes["Databases"] else w.get(f"x{i - 7}", 0.0) if i >= 7 else 0.0 for i in range(12)]
    table = {t: [1.0 if i == axes[c] else 0.0 for i in range(12)] for c, terms in TAXONOMY.items() for t in terms}
    table |= {"kubernetes": unit(cloud=0.84, x0=0.5426), "docker": unit(cloud=0.84, x1=0.5426), "azure": unit(cloud=0.84, x2=0.5426), "sql": unit(db=0.6, cloud=0.55, x2=0.58), "mysql": unit(db=0.8, cloud=0.3, x2=0.52), "cobol": unit(x4=1.0)}
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = spark.createDataFrame([(1, "sql"), (1, "kubernetes"), (1, "cobol"), (2, "mysql")], "analysis_id long, requirement string")
    skills = spark.createDataFrame([(1, "azure", False, "a", "Skills"), (1, "docker", True, "d", "Projects"), (2, "sql", True, "s", "Projects")], "analysis_id long, skill string, narrative boolean, chunk string, section string")
    got = {r.requirement: (r.relation, r.related_skill) for r in evaluation.relations(wanted, skills, lambda t: pairs[t]).collect()}
    assert got == {"sql": ("none", None), "kubernetes": ("related", "docker"), "cobol": ("none", None), "mysql": ("equivalent", "sql")}
    asked = wanted.selectExpr("*", "'must' AS importance", "1D AS weight", "0 AS position")
    none = spark.createDataFrame([], "analysis_id long, requirement string, chunk string, section string, score double, confidence int")
    status = {r.requirement: (r.status, r.covered) for r in scoring.verdicts(asked, none, evaluation.relations(wanted, skills, lambda t: pairs[t])).collect()}
    assert status == {"sql": ("Missing", False), "kubernetes": ("Missing", False), "cobol": ("Missing", False), "mysql": ("Matched", True)}


def test_history_with_reports(spark):
    analyses = spark.createDataFrame([(1, 1, 1, None, 5, None, None, None, "Applied", None), (2, 7, 1, 60, None, None, None, None, None, None)], "id long, resume_id long, jd_id long, overall_score int, coverage_score int, experience_score int, project_score int, quality_score int, workflow_status string, created_at timestamp_ntz")
    reports = spark.createDataFrame([(1, 77, 8, 1, 2, 3)], "analysis_id long, overall_score int, coverage_score int, experience_score int, project_score int, quality_score int")
    got = {r.id: r for r in scoring.with_reports(analyses, reports).collect()}
    assert (got[1].overall_score, got[1].coverage_score, got[1].has_report) == (77, 5, True)
    assert (got[2].overall_score, got[2].quality_score, got[2].has_report) == (60, 0, False)
    files = spark.createDataFrame([(1, "x")], "id long, filename string")
    detail = scoring.history_detail(analyses.select("id", "resume_id", "jd_id", "workflow_status", "created_at"), reports, files.where("1=0"), files).collect()
    assert [(r.id, r.resume_filename, r.jd_filename) for r in detail] == [(1, "", "x")]
    assert search.lookup(analyses, 2).first().overall_score == 60 and search.lookup(analyses, 9).count() == 0
    board = spark.createDataFrame([(1, "b", 50), (2, "a", 90), (3, "c", None)], "rank int, filename string, overall_score int")
    assert [r.filename for r in scoring.leaderboard_view(board, sort="name").collect()] == ["a", "b", "c"]
    assert [r.filename for r in scoring.leaderboard_view(board, 10).collect()] == ["a", "b"]


def test_trait_model_survives_saving(spark, tmp_path):
    rows = spark.createDataFrame([(f"{'good' if i % 2 else 'bad'} thing {i}", *([i % 2 * 1.0] * 5)) for i in range(20)], "Resume_Text string, " + ", ".join(f"{t} double" for t in traits.TRAITS))
    model = traits.train(rows)
    model.save(str(tmp_path / "m"))
    same = traits.load(str(tmp_path / "m")).transform(rows)
    assert sorted(map(str, same.collect())) == sorted(map(str, model.transform(rows).collect()))
    assert same.where(F.col("openness_score").isNull()).count() == 0


def test_evidence_and_owned_bm25_deal_texts_by_resume_alone(spark):
    """No exchange is by analysis, requirement or term, so pairs of requirements and chunks stay where their join made them."""
    docs = spark.createDataFrame([(1, 1, "a.pdf", GOOD), (2, 2, "b.pdf", POOR)], "resume_id long, candidate_id long, filename string, text string")
    chunks = evaluation.ingest(docs, spark.createDataFrame([], "resume_id long, sha string"))
    chunks = spark.createDataFrame(chunks.collect(), chunks.schema)
    asked = evaluation.job_requirements(spark.createDataFrame([(9, JD)], "jd_id long, text string"))
    asked = spark.createDataFrame(asked.collect(), asked.schema)
    pairs = spark.createDataFrame([(100 + i, i, 9) for i in (1, 2)], "analysis_id long, resume_id long, jd_id long")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = evaluation.evidence(pairs, chunks, asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt
    for keys in dealt:
        assert keys.startswith(("resume_id", "jd_id")), keys


def test_texts_are_encoded_and_read_for_terms_once(spark):
    """A resume's chunks that repeat a text, an analysis' rows that repeat a chunk and a job's requirements are worked on once each."""
    from assayer.operators import requirements, retrieval
    from assayer.plans import pipeline_catalog

    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def encode(text):
        calls.add(1)
        return [1.0, float(len(text))]

    text = "Skills\nPython and SQL.\nProjects\nPython and SQL.\nEducation\nNone of them.\nExperience\nPython and SQL."
    docs = spark.createDataFrame([(1, 1, "a", text), (2, 2, "b", text)], "resume_id long, candidate_id long, filename string, text string")
    got = evaluation.ingest(docs, spark.createDataFrame([], "resume_id long, sha string"), encode).collect()
    assert calls.value == 4 and len(got) == 8  # two texts of each resume
    assert sorted((r.resume_id, r.chunk_id, r.section, r.embedding[1]) for r in got if r.resume_id == 1) == [(1, 0, "Skills", 15.0), (1, 1, "Experience", 15.0), (1, 2, "Projects", 15.0), (1, 3, "Education", 13.0)]
    rows = [(1, k, "Uses Python and FastAPI.", s) for k, s in enumerate(["Skills", "Projects", "Experience", "Skills"])] + [(1, 0, "Python, AWS", "Projects"), (2, 1, None, None)]
    found = requirements.candidate_skills(spark.createDataFrame(rows, "analysis_id long, position long, chunk string, section string"))
    assert sorted(map(tuple, found.collect())) == [(1, "aws", True, "Python, AWS", "Projects"), (1, "fastapi", True, "Uses Python and FastAPI.", "Projects"), (1, "python", True, "Python, AWS", "Projects")]
    words = retrieval.bm25(spark.createDataFrame([(1, 1, "sql")], "o long, query_id long, text string"), spark.createDataFrame([(1, 1, "sql and sql"), (1, 2, None), (1, 3, "none")], "o long, doc_id long, text string"), by=("o",))
    assert "regexp_count" not in words._jdf.queryExecution().optimizedPlan().toString()
    import hashlib
    import math

    assert [round(r.score, 9) for r in words.collect()] == [round(math.log(1 + 2.5 / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (4 / 3))), 9)]
    want = [0.0] * 32
    for t in ["a", "b1", "c", "a"]:
        h = hashlib.md5(t.encode()).hexdigest()
        want[int(h[0], 16) % 2 * 16 + int(h[1], 16)] += 1 - int(h[2], 16) % 2 * 2
    length = math.sqrt(sum(x * x for x in want))
    vector = spark.createDataFrame([("A b1, c a",)], "t string").select(pipeline_catalog.digest_vector(F.col("t")).alias("v")).first().v
    assert max(abs(x - y / (length + 1e-9)) for x, y in zip(vector, want)) < 1e-12
