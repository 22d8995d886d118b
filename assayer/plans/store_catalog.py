"""Registered queries that store rows and read them back: uploads, reports, indexes, drops and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scores as S
from ..functions.json import object_in_text
from ..operators import encoder, retrieval, scoring, structuring, traits
from ..operators.requirements import STOP
from ..sources import files
from ..sources.buckets import BucketTable
from ..sources.shared import new_path
from ..sources.uploads import insert_uploads
from ..sources.views import SCORING, TEXTS, Tables, in_list, with_views
from ..streaming import events, ingest
from .registry import query

DOCX = files.SUFFIXES[".docx"][0]

UPLOADS = f"""WITH f AS (
  SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.PDF' ELSE '.txt' END AS filename, CASE WHEN page_id % 7 = 0 THEN 'text/plain' WHEN page_id % 4 = 1 THEN '{DOCX}' ELSE 'application/pdf' END AS mime_type,
         page_id % 3 = 0 AS later, (SELECT max(c_custkey) FROM customer) AS top FROM pages),
ok AS (SELECT * FROM f WHERE page_id % 7 <> 0 AND page_id % 4 <> 3),
n AS (SELECT *, top + row_number() OVER (ORDER BY later, filename, mime_type, page_id) AS id FROM ok)
"""


@query(UPLOADS + "SELECT id, page_id, id || '_' || filename AS stored, later FROM n UNION ALL SELECT NULL, page_id, NULL, later FROM f WHERE page_id % 7 = 0 OR page_id % 4 = 3")
def upload_insert(t: Tables) -> DataFrame:
    """Pages uploaded in two goes, into a table whose ids follow the customers'; refused ones have no id."""
    p = F.col("page_id")
    suffix = F.when(p % 4 == 0, ".pdf").when(p % 4 == 1, ".DOCX").when(p % 4 == 2, ".PDF").otherwise(".txt")
    kind = F.when(p % 7 == 0, "text/plain").when(p % 4 == 1, DOCX).otherwise("application/pdf")
    rows = t.read("pages").select(F.concat("url", suffix).alias("filename"), kind.alias("mime_type"), "page_id", (p % 3 == 0).alias("later"))
    folder, top = new_path(t.spark, "uploads"), t.read("customer").agg(F.max("c_custkey")).first()[0]
    out = []
    for later in (False, True):
        inserted, refused = insert_uploads(t.spark, folder, rows.where(F.col("later") == later), start=top or 0)
        out += [inserted.select("id", "page_id", "stored", "later"), refused.select(F.lit(None).cast("long").alias("id"), "page_id", F.lit(None).cast("string").alias("stored"), "later")]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("""SELECT o_orderkey AS analysis_id, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_custkey END AS resume_id, CASE WHEN o_orderkey % 5 = 0 THEN 'second' ELSE 'first' END AS version, n AS rows_of_id
FROM orders JOIN (VALUES (1), (2)) v(n) ON n = 1 OR o_orderkey % 5 = 0 WHERE o_orderkey % 11 <> 0""")
def bucket_replace(t: Tables) -> DataFrame:
    """Orders stored by id; a fifth replaced by two rows each, an eleventh taken out."""
    orders = t.read("orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").cast("long").alias("resume_id"))
    first = orders.select("*", F.lit("first").alias("version"), F.lit(1).alias("rows_of_id"))
    table = BucketTable(t.spark, new_path(t.spark, "orders"), first.schema, "analysis_id", 16)
    table.replace(first)
    again = orders.where("analysis_id % 5 = 0").select("analysis_id", F.lit(-1).cast("long").alias("resume_id"), F.lit("second").alias("version"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rows_of_id"))
    table.replace(again)
    table.replace(first.limit(0), orders.where("analysis_id % 11 = 0"))
    return table.rows()


@query(with_views(*TEXTS) + """SELECT r.doc_id, left(sha256(r.text), 32) AS sha, count(c.i) AS chunks, CASE WHEN r.doc_id % 3 = 2 AND r.doc_id % 2 = 1 OR r.doc_id % 3 = 0 THEN 0 ELSE 1 END AS batch
FROM resume_texts r LEFT JOIN chunked c ON c.doc_id = r.doc_id GROUP BY ALL HAVING count(c.i) > 0""")
def incremental_ingest(t: Tables) -> DataFrame:
    """Documents that arrive in two drops. A third comes in both: half of it unchanged, and then left alone, the others anew."""
    docs, d = t.resume_texts.select(F.col("doc_id").alias("resume_id"), "text"), F.col("resume_id")
    schema = StructType.fromDDL("resume_id long, section string, page int, text string, chunk_id long, sha string, batch int")
    folder, index, signs = new_path(t.spark, "drops"), BucketTable(t.spark, new_path(t.spark, "index"), schema, "resume_id", 16), new_path(t.spark, "signs")
    shape = StructType.fromDDL("resume_id long, text string, batch int")
    first = docs.where(d % 3 != 1).select("resume_id", F.when((d % 3 == 2) & (d % 2 == 0), F.concat(F.lit("Old. "), "text")).otherwise(F.col("text")).alias("text"), F.lit(0).alias("batch"))
    second = docs.where(d % 3 != 0).select("resume_id", "text", F.lit(1).alias("batch"))

    def make(rows: DataFrame) -> DataFrame:
        cut = structuring.chunks(rows, "resume_id", "text").withColumnRenamed("doc_id", "resume_id")
        return cut.join(rows.select("resume_id", "sha", "batch"), "resume_id").select(*schema.names)

    for drop in (first, second):
        drop.write.mode("append").parquet(folder)
        ingest.ingest_drops(t.spark, folder, shape, index, make, signs, order="batch")
    return index.rows().groupBy(F.col("resume_id").alias("doc_id"), "sha", "batch").agg(F.count(F.lit(1)).alias("chunks"))


@query("""WITH span AS (SELECT min(ts) AS a, date_diff('microsecond', min(ts), max(ts)) + 1 AS w FROM events),
placed AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN 3 ELSE CAST(floor(date_diff('microsecond', a, ts) * 4.0::DOUBLE / w) AS INT) END AS batch FROM events, span),
marks AS (SELECT b, (SELECT max(ts) - INTERVAL 1 DAY FROM placed WHERE batch < b) AS mark FROM range(5) r(b)),
kept AS (SELECT p.*, date_trunc('day', ts) + INTERVAL 1 DAY AS closes FROM placed p JOIN marks ON b = batch WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark)
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS count FROM kept, (SELECT mark AS last FROM marks WHERE b = 4) WHERE closes <= last GROUP BY ALL""")
def events_daily_stream(t: Tables) -> DataFrame:
    """Events in four drops, the stream restarted for each; some come so late that their day is closed already."""
    rows, spark = t.read("events").select("event_id", "ts", "event_type"), t.spark
    span = rows.agg(F.min("ts").alias("a"), (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))) + 1).alias("w"))
    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(span.select("a").scalar().cast("timestamp"))
    batch = F.when(F.col("event_id") % 17 == 0, 3).otherwise(F.floor(since * F.lit(4.0) / span.select("w").scalar()).cast("int"))
    placed, folder, days, signs = rows.withColumn("batch", batch), *(new_path(spark, n) for n in ("events", "days", "signs"))
    for k in range(4):
        placed.where(F.col("batch") == k).drop("batch", "event_id").write.mode("append").parquet(folder)
        events.daily_counts_of_folder(spark, folder, rows.drop("event_id").schema, signs, days).awaitTermination()
    return spark.read.schema("day string, event_type string, count long").parquet(days)


ANSWER = "'{\"turn\": ' || turn || ', \"said\": {\"role\": ' || to_json(role) || ', \"text\": ' || to_json(left(text, 200)) || '}}'"


@query(f"""WITH a AS (SELECT conv_id, turn, role, text, {ANSWER} AS j FROM conversations)
SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 8 < 6 THEN turn END AS told, CASE WHEN (conv_id + turn) % 8 < 6 THEN role END AS role, CASE WHEN (conv_id + turn) % 8 < 6 THEN left(text, 200) END AS said FROM a""")
def tolerant_json(t: Tables) -> DataFrame:
    """Answers around a turn's JSON: plain, fenced, in prose, before another object, before a stray brace; broken; none."""
    said = F.to_json(F.struct(F.col("turn"), F.struct("role", F.substring("text", 1, 200).alias("text")).alias("said")))
    answers = [said, F.concat(F.lit("```json\n"), said, F.lit("\n```")), F.concat(F.lit("Here it is: "), said, F.lit(" I hope that helps.")), F.concat(said, F.lit(' or {"turn": -1}')), F.concat(F.lit("```\n"), said, F.lit("\n``` }")), F.concat(F.lit("- "), said, F.lit(" :}")), F.substring(said, F.lit(1), F.length(said) - 1), F.lit("no { object ] here")]
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8))
    rows = t.read("conversations").select("conv_id", "turn", F.element_at(F.array(*answers), (k + 1).cast("int")).alias("answer"))
    found = rows.withColumn("found", object_in_text(F.col("answer")))
    value = lambda path, kind: F.try_variant_get("found", path, kind)
    return found.select("conv_id", "turn", value("$.turn", "long").alias("told"), value("$.said.role", "string").alias("role"), value("$.said.text", "string").alias("said"))


@query("""SELECT o_orderkey AS analysis_id, CASE o_orderkey % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'malformed' WHEN 2 THEN 'corrupt' ELSE 'ok' END AS state,
  CASE WHEN o_orderkey % 10 > 2 THEN CAST(o_custkey % 101 AS INT) END AS overall_score FROM orders""")
def stored_reports(t: Tables) -> DataFrame:
    """The state of each order's stored report: some were never written, some lack a field, some are cut."""
    key = F.col("o_orderkey")
    body = F.struct(key.alias("analysis_id"), (F.col("o_custkey") % 101).alias("overall_score"), F.array().cast("array<string>").alias("requirements"), F.when(key % 10 != 1, F.col("o_orderpriority")).alias("summary"))
    line = F.when(key % 10 == 2, F.regexp_replace(F.to_json(body), r"\}$", "")).otherwise(F.to_json(body))
    folder = new_path(t.spark, "reports")
    t.read("orders").where(key % 10 != 0).select(line.alias("value")).write.text(folder)
    scanned = files.scan_reports(t.spark, folder, glob="*.txt")
    return files.report_states(t.read("orders").select(key.alias("analysis_id")), scanned).select("analysis_id", "state", "overall_score")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = v.vec_id % 50 WHERE q.vec_id % 20 = 0)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def index_topk(t: Tables) -> DataFrame:
    """Every twentieth vector's five nearest within its resume, from the stored index of which only asked resumes' buckets are read."""
    rows = t.read("embeddings").select((F.col("vec_id") % 50).alias("resume_id"), F.col("vec_id").alias("chunk_id"), "embedding", S.fingerprint(F.col("vec_id").cast("string")).alias("sha"))
    index = files.index_table(t.spark, new_path(t.spark, "index"), rows.schema)
    index.replace(rows)
    asked = t.read("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 50).alias("resume_id"), F.col("embedding").alias("query"))
    return retrieval.index_topk(asked, index.of(asked), 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(r"""WITH w AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+#./-]*') AS t FROM documents)),
n AS MATERIALIZED (SELECT a, b, count(*) AS n FROM (SELECT x.w AS a, y.w AS b FROM w x JOIN w y ON x.doc_id = y.doc_id AND y.i IN (x.i - 2, x.i - 1, x.i + 1, x.i + 2)) GROUP BY ALL),
s AS MATERIALIZED (SELECT a, sum(n) AS na FROM n GROUP BY 1),
m AS (SELECT n.a, n.b, ln(n * (SELECT sum(na) FROM s)::DOUBLE / (s.na * r.na)) AS m FROM n JOIN s ON s.a = n.a JOIN s r ON r.a = n.b)
SELECT a AS word, count(*) AS neighbours, round(sum(m), 4) AS weight FROM m WHERE m > 1e-9 GROUP BY 1""")
def neighbour_weights(t: Tables) -> DataFrame:
    """What the encoder factorises: each word's neighbours that are more common than chance."""
    weights = encoder.pair_weights(encoder.neighbour_counts(t.read("documents"))).where("m > 1e-9")
    return weights.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("neighbours"), F.round(F.sum("m"), 4).alias("weight"))


@query()
def text_vectors(t: Tables) -> DataFrame:
    """All documents, encoded by word vectors learned from them."""
    docs = t.read("documents").select("doc_id", "text")
    once = encoder.distinct_texts(docs)
    return encoder.encoded(docs, encoder.word_vectors(once, "t", copies="copies"), once=once).select("doc_id", "vector")


@query("""WITH p AS (SELECT conv_id, turn, i, trim(l) AS line, role FROM (SELECT conv_id, turn, role, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM (SELECT conv_id, turn, role, string_split(regexp_replace(coalesce(text, ''), '[^\\n\\t\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]', ' ', 'g'), chr(10)) AS a FROM conversations))),
b AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, i) FILTER (line <> '') AS body FROM p GROUP BY 1), r AS (SELECT conv_id, string_agg(turn || ' | ' || role, chr(10) ORDER BY turn) AS rows FROM conversations GROUP BY 1)
SELECT conv_id, conv_id % 9 = 4 AS refused, CASE WHEN conv_id % 9 <> 4 THEN CASE WHEN body IS NULL THEN rows ELSE body || chr(10) || rows END END AS text FROM b JOIN r USING (conv_id)""")
def docx_texts(t: Tables) -> DataFrame:
    """Conversations as DOCX files, a paragraph a line and a table of turns, read back; some files are cut and give no text."""
    turns = t.read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    lines = F.flatten(F.transform("turns", lambda x: F.split(x["text"], "\n")))
    cells = F.transform("turns", lambda x: F.array(x["turn"].cast("string"), x["role"]))
    made = files.docx_files(turns.select(F.concat(F.col("conv_id").cast("string"), F.lit("_talk.docx")).alias("path"), lines.alias("paragraphs"), cells.alias("cells")))
    key = F.split_part("path", F.lit("_"), F.lit(1)).cast("long")
    sent = made.withColumn("content", F.when(key % 9 == 4, F.substring("content", 1, 40)).otherwise(F.col("content")))
    return files.parsed(sent).select(key.alias("conv_id"), F.col("error").isNotNull().alias("refused"), "text")


@query(with_views(*SCORING) + """, e AS (SELECT analysis_id, '{' || chr(10) || '  "analysis_id" : ' || analysis_id || ',' || chr(10) || '  "overall_score" : ' || overall_score || ',' || chr(10) || '  "keyword_stuffing_risk" : "' || keyword_stuffing_risk || '"' || chr(10) || '}' AS body FROM scored)
SELECT analysis_id, body, md5(body) AS etag FROM e""")
def report_export(t: Tables) -> DataFrame:
    """The download of each report and its entity tag."""
    scores = scoring.sub_scores(scoring.verdicts(t.requirements, t.matches))
    return files.export_json(scores.select("analysis_id", "overall_score", "keyword_stuffing_risk"))


@query("""SELECT p_partkey::VARCHAR AS rank, p_name || ', "' || p_brand || '"' AS name, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS score, CASE WHEN p_size > 1 THEN p_type || '; ' || p_brand ELSE p_type END AS missing FROM part""")
def ranking_csv(t: Tables) -> DataFrame:
    """A ranking written as CSV and read back as text: quotes and commas kept, lists joined, no value where none was."""
    kinds = F.when(F.col("p_size") > 1, F.array("p_type", "p_brand")).otherwise(F.array("p_type"))
    rows = t.read("part").select(F.col("p_partkey").alias("rank"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("score"), kinds.alias("missing"))
    folder = new_path(t.spark, "ranking")
    files.write_ranking_csv(rows, folder)
    return t.spark.read.schema("rank string, name string, score string, missing string").option("header", True).option("escape", "\\").csv(folder)


@query("""SELECT CASE WHEN text = '' THEN NULL ELSE text END AS "Resume_Text", conv_id::DOUBLE AS "Extroversion", turn::DOUBLE AS "Conscientiousness", length(text)::DOUBLE / 8 AS "Openness", NULL::DOUBLE AS "Agreeableness", -0.5::DOUBLE AS "Neuroticism" FROM conversations""")
def traits_csv(t: Tables) -> DataFrame:
    """Texts with quotes, commas and line breaks beside five numbers, from a CSV file with a header."""
    rows = t.read("conversations").select(F.col("text").alias("Resume_Text"), *(x.cast("double").alias(n) for x, n in zip((F.col("conv_id"), F.col("turn"), F.length("text") / 8, F.lit(None), F.lit(-0.5)), traits.TRAITS)))
    folder = new_path(t.spark, "traits")
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return files.read_traits_csv(t.spark, folder)


@query(f"""SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z \\t\\n\\x0B\\f\\r]', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains([{in_list(STOP)}], w)), ' ') AS words FROM documents""")
def preprocessed_text(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", traits.preprocessed(F.col("text"), STOP).alias("words"))
