"""Queries: smaller pipeline steps."""

from pyspark.sql import functions as F

from lorebase.operators import pipeline as P
from lorebase.operators import usage as U
from lorebase.plans.catalogue import query, table
from lorebase.plans.usage import EV, STATS, events


@query(f"WITH {EV}, m AS (SELECT session_id, event_id, left(regexp_replace(regexp_replace(coalesce(content, ''), '<[^>]+>.*?</[^>]+>', '', 'gs'), '^\\s+|\\s+$', '', 'g'), 300) AS t FROM ev WHERE speaker = 'user'), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS r FROM m WHERE length(t) > 5) SELECT session_id, string_agg(t, chr(10) ORDER BY event_id) AS messages FROM k WHERE r <= 8 GROUP BY 1")
def last_messages(spark, folder):
    e = events(spark, folder).where("speaker = 'user'").select("session_id", "event_id", F.coalesce("content", F.lit("")).alias("text"))
    return P.last_messages(e).select("session_id", F.array_join("messages", "\n").alias("messages"))


@query("SELECT DISTINCT id, CASE WHEN regexp_matches(lower(title), '\\b(compare|vs|versus)\\b') THEN 'compare' WHEN regexp_matches(lower(title), '^(how|why)\\b') THEN 'explain' WHEN regexp_matches(lower(title), '\\bchecklist\\b') THEN 'list' ELSE 'retrieve' END AS route FROM issues")
def intent_routes(spark, folder):
    rules = [(r"\b(compare|vs|versus)\b", "compare"), (r"^(how|why)\b", "explain"), (r"\bchecklist\b", "list")]
    return table(spark, folder, "issues").select("id", P.routed(F.col("title"), rules).alias("route")).distinct()


@query("WITH p AS (SELECT DISTINCT note_id, source FROM notes), l AS (SELECT * FROM (VALUES ('paper', 'figure'), ('course', 'diagram'), ('article', 'concept')) t(source, look)) SELECT note_id, p.source, coalesce(look, 'concept') AS look FROM p LEFT JOIN l USING (source)")
def lookup_with_default(spark, folder):
    rows = table(spark, folder, "notes").select("note_id", "source").distinct()
    looks = spark.createDataFrame([("paper", "figure"), ("course", "diagram"), ("article", "concept")], "source string, look string")
    return P.with_default(rows, looks, "source", "look", "article")


@query("WITH s AS (SELECT doc_id, collection AS slide, coalesce(lang, 'und') AS kind FROM documents), i AS (SELECT DISTINCT doc_id FROM labels) SELECT s.doc_id AS slide, CASE WHEN kind IN ('en', 'und') THEN 'text' WHEN i.doc_id IS NOT NULL THEN 'image' ELSE 'text' END AS route FROM s LEFT JOIN i ON i.doc_id = s.doc_id")
def slide_routes(spark, folder):
    slides = table(spark, folder, "documents").select(F.col("doc_id").alias("slide"), F.coalesce("lang", F.lit("und")).alias("kind"))
    return P.slide_routes(slides, table(spark, folder, "labels").select(F.col("doc_id").alias("slide")), ("en", "und"))


@query("WITH n AS (SELECT DISTINCT id FROM nodes), f AS (SELECT id FROM n WHERE id LIKE '%queue%'), h AS (SELECT id FROM n WHERE id LIKE 'a%') SELECT n.id, CASE WHEN h.id IS NOT NULL THEN 'shown' ELSE 'dimmed' END AS state FROM n LEFT JOIN h ON h.id = n.id")
def node_visibility(spark, folder):
    n = table(spark, folder, "nodes").select("id").distinct()
    return P.visibility(n, n.where("id LIKE 'a%'"), None, n.where("id LIKE '%queue%'"))


@query("SELECT note_id, CASE WHEN t = '' THEN 'empty' WHEN length(t) > 4000 THEN 'too long' WHEN regexp_matches(t, '(?i)ignore (all|previous) instructions|system prompt:') THEN 'blocked' END AS reason FROM (SELECT DISTINCT note_id, regexp_replace(regexp_replace(coalesce(body, ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM notes)")
def input_guard(spark, folder):
    n = table(spark, folder, "notes").select("note_id", "body").distinct()
    return n.select("note_id", P.envelope(F.col("body"))["reason"].alias("reason"))


@query("SELECT doc_id, source, CASE WHEN coalesce(n_chars > 20000, false) THEN 'signal' ELSE 'sample' END AS reason FROM documents WHERE coalesce(n_chars > 20000, false) OR ('0x' || left(md5('review ' || doc_id), 8))::BIGINT % 10000 < 500")
def review_sample(spark, folder):
    d = table(spark, folder, "documents")
    return P.review_sample(d, "doc_id", "source", 0.05, F.coalesce(F.col("n_chars") > 20_000, F.lit(False)))


@query(f"""WITH {STATS}, n AS (SELECT session_id, coalesce(b->>'name', 'unknown') AS name, count(*) AS n FROM blk WHERE b->>'type' = 'tool_use' AND (speaker = 'assistant' OR type = 'tool_call') GROUP BY 1, 2),
top AS (SELECT session_id, string_agg(name || '×' || n, ', ' ORDER BY n DESC, name) AS tools FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, name) AS r FROM n) WHERE r <= 3 GROUP BY 1),
asked AS (SELECT session_id, left(arg_min(t, ats::HUGEINT * 1000000000000 + event_id), 120) AS prompt FROM text WHERE speaker = 'user' AND t <> '' AND ats IS NOT NULL GROUP BY 1)
SELECT session_id, concat_ws(' | ', coalesce(prompt, ''), coalesce(tools, '')) AS line FROM stat LEFT JOIN top USING (session_id) LEFT JOIN asked USING (session_id) ORDER BY start_us DESC LIMIT 30""")
def prompt_summary(spark, folder):
    return P.prompt_summary(U.session_statistics(events(spark, folder)))
