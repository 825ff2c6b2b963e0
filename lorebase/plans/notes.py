"""Queries: rendering, sections, prompts, constraints."""

from pyspark.sql import functions as F

from lorebase.functions import text as X
from lorebase.operators import rendering as R
from lorebase.operators import usage as U
from lorebase.plans.catalogue import query, table
from lorebase.plans.usage import EV, events


@query("""SELECT DISTINCT id, '### [' || identifier || '] ' || title || chr(10) || '**Status:** ' || state.name || '  ' || chr(10) || '**Priority:** ' || coalesce(priority::VARCHAR, 'None') || '  ' || chr(10) || '**Assignee:** ' || coalesce(assignee.name, 'Unassigned') || '  ' || chr(10)
|| '**Labels:** ' || coalesce(nullif(array_to_string(list_transform(labels.nodes, lambda n: n.name), ', '), ''), 'None') || '  ' || chr(10) || '**URL:** ' || url || '  ' || chr(10) || chr(10) || coalesce(nullif(description, ''), '_No description._')
|| CASE WHEN len(comments.nodes) > 0 THEN chr(10) || chr(10) || '**Comments:**' || chr(10) || array_to_string(list_transform(comments.nodes, lambda c: '> **' || coalesce(c.user.name, 'Unknown') || '** (' || coalesce(strftime(c.created_at, '%Y-%m-%d'), '') || '): ' || coalesce(c.body, '')), chr(10)) ELSE '' END AS markdown FROM issues""")
def issue_markdown(spark, folder):
    return R.issue_markdown(table(spark, folder, "issues")).distinct()


@query("""SELECT DISTINCT note_id, '---' || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || 'source: ' || coalesce(source, '') || chr(10) || 'topic: ' || coalesce(topic, '') || chr(10) || 'tags: [' || array_to_string(tags, ', ') || ']' || chr(10) || 'date: ' || coalesce(date, '') || chr(10) || 'relevance: ' || coalesce(relevance::VARCHAR, '') || chr(10) || 'source_file: ' || coalesce(source_file, '') || chr(10) || 'pages: ' || coalesce(pages, '') || chr(10) || '---' || chr(10) || chr(10) || coalesce(body, '') AS markdown FROM notes""")
def note_markdown(spark, folder):
    return R.note_markdown(table(spark, folder, "notes")).distinct()


@query("SELECT DISTINCT note_id, NOT coalesce(relevance BETWEEN 1 AND 5, false) AS bad_relevance, NOT coalesce(source IN ('book-chapter', 'paper', 'course', 'article'), false) AS bad_source FROM notes WHERE NOT coalesce(relevance BETWEEN 1 AND 5, false) OR NOT coalesce(source IN ('book-chapter', 'paper', 'course', 'article'), false)")
def note_constraints(spark, folder):
    p = R.note_problems(table(spark, folder, "notes"))
    return p.select("note_id", F.array_contains("broken", "relevance").alias("bad_relevance"), F.array_contains("broken", "source").alias("bad_source")).distinct()


@query(r"""SELECT doc_id, regexp_replace(regexp_extract(text, '(?m)^- \*\*Work\*\*:(.*)$', 1), '^\s+|\s+$', '', 'g') AS work, nullif(regexp_replace(regexp_extract(text, '(?m)^- \*\*Status\*\*:(.*)$', 1), '^\s+|\s+$', '', 'g'), '') AS status
FROM documents WHERE regexp_matches(text, '(?m)^## Position\r?\n') AND regexp_matches(text, '(?m)^- \*\*Work\*\*: \S')""")
def session_note_records(spark, folder):
    return R.session_notes(table(spark, folder, "documents").where("text IS NOT NULL"), "doc_id").select("doc_id", "work", "status")


@query(f"WITH {EV}, m AS (SELECT event_id, session_id, regexp_replace(CASE WHEN starts_with(content, '[{{') AND json_valid(content) THEN coalesce(list_filter(from_json(content, '[\"JSON\"]'), lambda b: b->>'type' IN ('text', 'input_text'))[1]->>'text', '') WHEN starts_with(content, '[{{') THEN '' ELSE content END, '^\\s+|\\s+$', '', 'g') AS t FROM ev WHERE speaker = 'user') SELECT event_id, session_id, left(t, 300) AS prompt FROM m WHERE length(t) > 20 AND NOT starts_with(t, '<')")
def user_prompts(spark, folder):
    e = events(spark, folder).where("speaker = 'user'")
    block = F.try_element_at(F.filter(U.blocks(F.col("content")), lambda b: b["type"].isin("text", "input_text")), F.lit(1))["text"]
    t = X.strip(F.when(F.col("content").startswith("[{"), F.coalesce(block, F.lit(""))).otherwise(F.col("content")))
    return e.select("event_id", "session_id", t.alias("t")).where((F.length("t") > 20) & ~F.col("t").startswith("<")).select("event_id", "session_id", F.substring("t", 1, 300).alias("prompt"))


@query("SELECT DISTINCT source_file, CASE WHEN contains(lower(source_file), 'course') OR contains(lower(source_file), 'lecture') THEN 'course' WHEN regexp_matches(source_file, '(^|/)[0-3]\\.') THEN 'book-chapter' ELSE 'paper' END AS kind, CASE WHEN regexp_matches(source_file, '(^|/)pdf/') THEN 'papers' END AS topic FROM notes")
def source_types(spark, folder):
    f = F.col("source_file")
    return table(spark, folder, "notes").select(f, R.source_type(f).alias("kind"), R.topic_of(f, {"pdf": "papers", "web": "captures"}).alias("topic")).distinct()


@query(f"WITH {EV}, r AS (SELECT session_id, event_id, coalesce(content, '') AS c, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY session_id) AS n FROM ev WHERE speaker = 'user') SELECT session_id, coalesce(string_agg(c, chr(10) ORDER BY event_id) FILTER (n >= 8 AND k <= n - 4), '') AS older, count(*) FILTER (n < 8 OR k > n - 4) AS kept FROM r GROUP BY 1")
def message_compaction(spark, folder):
    e = events(spark, folder).where("speaker = 'user'").withColumn("content", F.coalesce("content", F.lit("")))
    return R.folded_messages(e, "session_id", "event_id", "content").select("session_id", "older", F.size("kept").cast("long").alias("kept"))
