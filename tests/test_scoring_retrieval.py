"""Verdicts, reports, leaderboards, BM25, fusion and vector search on small cases."""

import math
import random

import pytest
from assayer.functions import scores as S
from assayer.functions.vectors import dot, norm, normalised
from assayer.operators import analytics, retrieval, scoring
from pyspark.sql import functions as F

REQ = "analysis_id long, requirement string, importance string, weight double, position long"
MATCH = "analysis_id long, requirement string, chunk string, section string, score double, confidence long"


def case(spark, requirements, matches, relations=None):
    r = spark.createDataFrame([(1, n, i, w, p) for p, (n, i, w) in enumerate(requirements)], REQ)
    m = spark.createDataFrame([(1, *x) for x in matches], MATCH)
    return scoring.verdicts(r, m, relations)


def test_three_verdicts(spark):
    rows = case(spark, [("python", "must", 1.0), ("tensorflow", "must", 1.0), ("docker", "must", 1.0)], [("python", "p" * 160, "Experience", 0.92, None), ("tensorflow", "t" * 40, "Skills", 0.81, None)])
    got = {r.requirement: (r.status, r.confidence) for r in rows.collect()}
    assert got["python"][0] == "Matched" and got["python"][1] >= 75
    assert got["tensorflow"][0] == "Partial" and got["docker"] == ("Missing", 0)
    assert scoring.sub_scores(rows).first().overall_score < 75


def test_weighted_coverage(spark):
    rows = case(spark, [("a", "must", 1.0), ("b", "nice", 0.4)], [("a", "x", "Skills", 0.9, 90)])
    assert scoring.weighted_coverage(rows).first().coverage_score == 71
    assert scoring.weighted_coverage(case(spark, [("a", "must", 0.0)], [])).first().coverage_score == 0


@pytest.mark.parametrize(
    "matches,want",
    [
        ([("a", "x" * 200, "Experience", 0.9, 90), ("b", "y" * 200, "Projects", 0.9, 90)], (1.0, 100, "Low", 100)),
        ([("a", "x" * 200, "Experience", 0.9, 90), ("b", "y", "Skills", 0.9, 90)], (0.5, 50, "High", 70)),
        ([], (0.0, 0, "Low", 0)),
    ],
)
def test_authenticity(spark, matches, want):
    r = scoring.authenticity(case(spark, [("a", "must", 1.0), ("b", "must", 1.0)], matches)).first()
    assert (r.corroboration_ratio, r.credibility_score, r.keyword_stuffing_risk, r.quality_score) == want


def test_relations(spark):
    relations = spark.createDataFrame([(1, "mysql", "SQL", 0.83, "equivalent", True, "used SQL"), (1, "k8s", "docker", 0.7, "related", True, "ran docker")], "analysis_id long, requirement string, related_skill string, cosine double, relation string, narrative boolean, skill_chunk string")
    rows = case(spark, [("mysql", "must", 1.0), ("k8s", "nice", 0.4), ("cobol", "must", 1.0)], [], relations)
    got = {r.requirement: (r.status, r.confidence, r.evidence) for r in rows.collect()}
    assert got == {"mysql": ("Matched", 83, "used SQL"), "k8s": ("Missing", 0, ""), "cobol": ("Missing", 0, "")}
    assert {r.requirement: r.estimated_time for r in scoring.learning_roadmap(rows).collect()} == {"k8s": "10-14 days", "cobol": "21-28 days"}
    report = scoring.reports(rows).first()
    assert report.missing_skills == ["k8s", "cobol"] and report.weaknesses[0] == "Missing must-have: cobol"
    assert report.rejection_email and report.authenticity.over_claimed_skills == []
    assert scoring.ranking_rows(scoring.reports(rows)).first().top_missing_skills == ["k8s", "cobol"]


def test_leaderboard(spark):
    rows = spark.createDataFrame([(1, 10, 0, 55, None), (1, 11, 1, 90, None), (1, 12, 2, 72, None), (1, 13, 3, None, "failed"), (1, 11, 4, 1, None), (1, 14, 5, 90, None)], "jd_id long, resume_id long, position long, overall_score long, error string")
    got = [(r.resume_id, r.rank) for r in scoring.leaderboard(rows).orderBy("rank").collect()]
    assert got == [(11, 1), (14, 2), (12, 3), (10, 4), (13, 5)]
    assert tuple(scoring.ranking_summary(scoring.leaderboard(rows)).first()) == (1, 5, 4)


def test_priorities_overlay_and_interview(spark):
    results = spark.createDataFrame([(1, "Python"), (1, "Go")], "analysis_id long, requirement string")
    known = spark.createDataFrame([(1, "python", "must", 1.0, 0), (1, "PYTHON", "nice", 0.4, 1), (2, "go", "nice", 0.4, 9)], "analysis_id long, requirement string, importance string, weight double, position int")
    assert {r.requirement: (r.importance, r.weight) for r in scoring.with_priorities(results, known).collect()} == {"Python": ("nice", 0.4), "Go": ("must", 1.0)}
    fits = spark.createDataFrame([(1, "text", 3)], "analysis_id long, summary string, overall_score int")
    assert tuple(scoring.overlay(fits, spark.createDataFrame([(1, 9)], "analysis_id long, overall_score int")).first()) == (1, "text", 9)
    asked = spark.createDataFrame([(1, 1, "Tell me about React Native work"), (1, 2, "Anything else?")], "analysis_id long, question_id int, question string")
    names = spark.createDataFrame([(1, "react", 0, "Partial", "e", 40), (1, "React Native", 1, "Matched", "built it", 90)], "analysis_id long, requirement string, position int, status string, evidence string, confidence long")
    got = {r.question_id: r for r in scoring.interview_answers(scoring.interview_match(asked, names)).collect()}
    assert (got[1].verdict, got[1].follow_up_questions, got[2].verdict) == ("backed", [], "gap") and len(got[2].follow_up_questions) == 1


def plain_bm25(query, docs, k1=1.5, b=0.75):
    import re

    cut = [re.findall(r"[a-z0-9][a-z0-9+#./-]*", d.lower()) for d in docs]
    mean = sum(map(len, cut)) / len(cut)
    out = []
    for words in cut:
        total = 0.0
        for t in re.findall(r"[a-z0-9][a-z0-9+#./-]*", query.lower()):
            df = sum(t in w for w in cut)
            if df and t in words:
                tf = words.count(t)
                total += math.log(1 + (len(cut) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
        out.append(total)
    return out


def test_bm25(spark):
    texts = ["python and docker docker", "java spring", "", "docker compose c++ node.js"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Docker docker python"), (2, "absent"), (3, "")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(queries, docs).collect()}
    want = {(1, i): s for i, s in enumerate(plain_bm25("Docker docker python", texts)) if s}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert retrieval.bm25(queries, docs.where("1=0")).count() == 0


def test_fusion(spark):
    rows = spark.createDataFrame([(1, "A", 1, 95, 9.0), (1, "B", 2, 60, 1.0), (1, "C", 3, 60, 1.0)], "query_id int, item_id string, position int, dense int, sparse double")
    got = retrieval.fuse(rows).orderBy("rank").collect()
    assert [r.item_id for r in got] == ["A", "B", "C"] and abs(got[0].fused - 1 / 60) < 1e-12


def test_vectors(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0], 0), (2, [0.0, 2.0], 1), (3, [3.0, 4.0], 0)], "vec_id long, embedding array<float>, label int")
    r = v.where("vec_id = 1").select(dot(F.col("embedding"), F.col("embedding")).alias("d"), norm(F.col("embedding")).alias("n"), normalised(F.col("embedding")).alias("u")).first()
    assert r.d == 25 and r.n == 5 and abs(r.u[0] - 0.6) < 1e-8
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query array<double>")
    assert [(x.vec_id, x.rank) for x in retrieval.vector_topk(q, v, 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    assert retrieval.vector_topk(q, v, 2, floor=99.0).count() == 0
    assert retrieval.with_queries(v, q.union(q.selectExpr("8L", "query")), most=1).count() == 6
    assert {x.category for x in retrieval.classify(v, retrieval.centroids(v)).collect()} == {"0", "1"}


def test_hybrid_keeps_one_chunk_per_text_over_the_floor(spark):
    chunks = [(i, f"text {w} number {i // 2}", s, 0, v) for i, (w, s, v) in enumerate([("python", "Experience", [1.0, 0.0]), ("python", "Skills", [0.9, 0.1]), ("java", "Projects", [0.8, 0.6]), ("java", "Projects", [0.0, 1.0])])]
    got = retrieval.hybrid(spark.createDataFrame([(1, "java", [1.0, 0.0])], "query_id int, text string, query array<double>"), spark.createDataFrame(chunks, "chunk_id int, text string, section string, technical int, embedding array<double>")).orderBy("rank").collect()
    assert [r.item_id for r in got] == [0, 2] and all(r.cosine >= 0.62 for r in got)


def test_score_columns(spark):
    rows = spark.createDataFrame([(None,), (59,), (60,), (75,), (80,)], "x int")
    got = rows.select(S.recommendation(F.col("x")).alias("r"), S.fit_category(F.col("x")).alias("f"), S.hiring_risk(F.col("x")).alias("h")).collect()
    assert [r.r for r in got] == ["Rejected", "Rejected", "Borderline", "Borderline", "Selected"]
    assert [r.f for r in got] == [None, "Rejected", "Borderline", "Selected", "Selected"]
    assert [r.h for r in got] == [None, "High", "Medium", "Low", "Low"]
    tone = spark.createDataFrame([("Highly Recommended",), ("Not Recommended - Reject",), ("Conditional",), ("x",)], "t string")
    assert [r.c for r in tone.select(S.recommendation_tone(F.col("t")).alias("c")).collect()] == ["success", "danger", "warning", "neutral"]


def test_bm25_of_each_owner_is_a_corpus_of_its_own(spark):
    texts = {1: ["Built ETL pipelines on Snowflake and Airflow.", "Delivered features on time.", "Deep experience with Kubernetes and Docker, kubernetes again."], 2: ["Kubernetes", "kubernetes and more words", None]}
    docs = spark.createDataFrame([(o, i, t) for o, ts in texts.items() for i, t in enumerate(ts)], "owner int, doc_id int, text string")
    asked = spark.createDataFrame([(1, "q", "Kubernetes docker"), (2, "q", "Kubernetes docker"), (2, "none", "golang")], "owner int, query_id string, text string")
    got = {(r.owner, r.query_id, r.doc_id): r.score for r in retrieval.bm25(asked, docs, by=("owner",)).collect()}
    for o, ts in texts.items():
        alone = retrieval.bm25(asked.where(f"owner = {o}").drop("owner"), docs.where(f"owner = {o}").drop("owner"))
        for r in alone.collect():
            assert got.pop((o, r.query_id, r.doc_id)) == pytest.approx(r.score)
    assert not got


def test_what_an_equivalent_skill_meets_is_no_gap(spark):
    asked = spark.createDataFrame([(1, r, "must", 1.0, i) for i, r in enumerate(["sql", "go", "rust", "java", "css"])], "analysis_id long, requirement string, importance string, weight double, position int")
    matches = spark.createDataFrame([(1, "java", "wrote java", "Experience", 0.9, 90), (1, "css", "css", "Skills", 0.5, 40)], "analysis_id long, requirement string, chunk string, section string, score double, confidence int")
    related = spark.createDataFrame([(1, "sql", "mysql", 0.9, "equivalent", False, "MySQL"), (1, "go", "golang", 0.95, "equivalent", True, "Golang at work"), (1, "rust", "c++", 0.7, "related", True, "c"), (1, "java", "kotlin", 0.7, "related", True, "k")], "analysis_id long, requirement string, related_skill string, cosine double, relation string, narrative boolean, skill_chunk string")
    rows = scoring.verdicts(asked, matches, related).cache()
    assert {r.requirement: r.status for r in rows.collect()} == {"sql": "Partial", "go": "Matched", "rust": "Missing", "java": "Matched", "css": "Partial"}
    assert {r.requirement: r.estimated_time for r in scoring.learning_roadmap(rows).collect()} == {"rust": "10-14 days", "css": "2-4 days"}
    report = scoring.reports(rows).first()
    assert report.weaknesses == ["Missing must-have: rust", "css: named, not backed by project work"]
    assert report.strengths == ["sql through mysql", "go through golang", "java"]
    assert report.skill_relationships == ["mysql counts as sql.", "golang counts as go.", "rust is a short way from c++.", "Work with kotlin backs java."]
    assert [q.split()[0] for q in report.interview_questions] == ["How", "Which", "Which", "Which", "Which"] and "rust" in report.interview_questions[0]
    assert [r.reason != "" for r in report.learning_roadmap] == [True, True] and report.authenticity.over_claimed_skills == ["css"]
    assert sorted((r.kind, r.skill, r["count"]) for r in analytics.verdict_frequency(rows).collect()) == [("matched", "go", 1), ("matched", "java", 1), ("missing", "rust", 1)]
    answers = scoring.interview(scoring.reports(rows), spark.createDataFrame([(1, 1, "About java?")], "analysis_id long, question_id int, question string")).first()
    assert answers.evidence == "wrote java" and answers.missing_information


def test_more_queries_than_a_block_holds(spark):
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    asked = spark.range(20_000).select(F.col("id").alias("query_id"), F.array(F.col("id") % 3 - 1.0, F.lit(0.5)).alias("query"))
    top = retrieval.vector_topk(asked, vectors, 2).collect()
    assert len(top) == 40_000
    best = {k: sorted((-((k - 1) * (i % 5) + 0.5), i) for i in range(20))[:2] for k in range(3)}
    assert all(best[r.query_id % 3][r["rank"] - 1] == (-r.score, r.vec_id) for r in top)
    assert retrieval.with_queries(vectors, asked.limit(0)).count() == 0


def test_vector_topk_on_ties_lengths_and_odd_vectors(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1.0, 0.1, 0.2, 0.3]) for _ in range(rnd.choice([3, 3, 3, 2]))]) for i in range(400)] + [(500 + i, [0.1, 0.2, 0.3]) for i in range(40)]
    rows += [(900, None), (901, [None, 1.0, 1.0]), (902, [float("nan"), 1.0, 1.0]), (903, [float("inf"), 1.0, 1.0]), (904, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    asked = [(i, [rnd.choice([0.3, -0.7, 1.1]) for _ in range(3 if i % 5 else 2)]) for i in range(30)] + [(77, None), (78, [1.0])]
    got = retrieval.vector_topk(spark.createDataFrame(asked, "query_id long, query array<double>"), vectors, 7, most=11).collect()
    want = []
    for q, v in asked:
        scored = []
        for i, x in rows:
            if v and x and len(x) == len(v) and all(y is not None and math.isfinite(y) for y in x):
                total = 0.0
                for a, b in zip(x, v):
                    total += a * b
                scored.append((-total, i))
        want += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(scored)[:7], 1)]
    assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in got) == sorted(want)
    near = retrieval.vector_topk(spark.createDataFrame(asked, "query_id long, query array<double>"), vectors, 7, floor=0.5).collect()
    assert sorted((r.query_id, r.vec_id) for r in near) == sorted((q, i) for q, i, s, _ in want if math.floor(s * 1000 + 0.5) / 1000 >= 0.5)


def test_index_topk_makes_no_pairs(spark):
    """One owner with many queries and chunks, blocks of queries, ties, other lengths and no owner; pairs are never joined rows."""
    rng = random.Random(1)
    vec = lambda: [float(rng.randrange(-3, 4)) for _ in range(4)]
    asked = [(i, None if i == 3 else i % 2, vec()) for i in range(60)]
    held = [(i, None if i == 5 else i % 3, vec() if i % 50 else [1.0]) for i in range(200)]
    a, c = spark.createDataFrame(asked, "query_id long, resume_id long, query array<double>"), spark.createDataFrame(held, "resume_id long, owner long, e array<float>").toDF("chunk_id", "resume_id", "embedding")
    best = retrieval.index_topk(a, c.repartition(3), 5, most=25)
    assert "Join" not in best._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in best.collect()}
    want = {}
    for q, o, v in asked:
        near = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, p, w in held if p == o and o is not None and len(w) == 4)
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(near[:5])}
    assert got == want


def test_bm25_shuffles_no_pairs(spark):
    """Scores of a whole corpus against the plain formula, with repeated ids and null texts; no join or aggregate after the scan of documents."""
    rng = random.Random(2)
    docs = [(i, None if i % 13 == 0 else " ".join(rng.choice("abcdefgh") + "x" for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    asked = [(q, " ".join(rng.choice("abcdwz") + "x" for _ in range(5))) for q in range(9)]
    a, rows = spark.createDataFrame(asked, "query_id long, text string"), "doc_id long, text string"
    for held in (docs, [*docs, (3, "ax bx"), (3, "ax dx"), (4, "ax")]):
        cut = {}
        for i, text in held:
            words = (text or "").split()
            cut.setdefault((i, len(words)), []).extend(words)
        n, avg = len(held), sum(len((x or "").split()) for _, x in held) / len(held)
        want = {}
        for q, text in asked:
            for (i, length), words in cut.items():
                for w in text.split():
                    if w in words:
                        df, tf = sum(w in x for x in cut.values()), words.count(w)
                        want[q, i] = want.get((q, i), 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg))
        scores = retrieval.bm25(a, spark.createDataFrame(held, rows))
        got = {(r.query_id, r.doc_id): r.score for r in scores.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        if held is docs:
            plan = scores._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Join" not in plan
            few = retrieval.bm25(a, spark.createDataFrame(held, rows), only=spark.createDataFrame([(7,), (8,)], "doc_id long")).collect()
            assert {(r.query_id, r.doc_id): r.score for r in few} == {k: v for k, v in got.items() if k[1] in (7, 8)}


def test_reports_shuffle_verdicts_once(spark):
    """One aggregate makes all of a report, behind one shuffle of verdicts."""
    fields = "analysis_id long, requirement string, position long, importance string, weight double"
    wanted = spark.createDataFrame([(1, "java", 1, "must", 1.0), (1, "sql", 2, "nice", 0.4), (2, "go", 1, "must", 1.0)], fields)
    found = spark.createDataFrame([(1, "java", "Built services in java for years", "Experience", 0.9, 90)], "analysis_id long, requirement string, chunk string, section string, score double, confidence long")
    made = scoring.reports(scoring.verdicts(wanted, found))
    shuffles = [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(analysis_id#" in x]
    assert len([x for x in shuffles if "requirement#" not in x]) == 1
    rows = {r.analysis_id: r for r in made.collect()}
    assert rows[1].missing_skills == ["sql"] and [x.skill for x in rows[1].learning_roadmap] == ["sql"]
    assert rows[2].weaknesses == ["Missing must-have: go"] and rows[2].skill_relationships == []
    done = scoring.reports(scoring.verdicts(wanted.where("requirement = 'java'"), found)).first()
    assert done.learning_roadmap is None and done.weaknesses == []
