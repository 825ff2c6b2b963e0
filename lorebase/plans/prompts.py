"""Queries: prompts, texts to embed, replies, reranking."""

from pyspark.sql import functions as F

from lorebase.operators import prompts as P
from lorebase.plans.catalogue import query, table
from lorebase.plans.search import CURRENT, pages
from lorebase.plans.usage import EV, events


@query(r"""WITH d AS (SELECT DISTINCT ON (event_id) event_id, session_id, type, role, content FROM session_events WHERE session_id IS NOT NULL ORDER BY event_id),
t AS (SELECT event_id, session_id, list_transform(list_filter(from_json(content, '["JSON"]'), lambda b: b->>'type' = 'input_text'), lambda b: regexp_replace(coalesce(b->>'text', ''), '^\s+|\s+$', '', 'g')) AS ts FROM d WHERE type = 'message' AND role = 'user' AND starts_with(content, '[') AND json_valid(content)),
c AS (SELECT event_id, session_id, list_filter(list_transform(list_filter(ts, lambda t: length(t) > 20 AND NOT starts_with(t, '<environment_context')), lambda t: regexp_replace(regexp_replace(t, '\A#\s*Context from my IDE.*?\n.*?\n', '', 's'), '^\s+|\s+$', '', 'g')), lambda t: length(t) > 20) AS cs FROM t)
SELECT event_id, session_id, left(cs[1], 300) AS prompt FROM c WHERE len(cs) > 0""")
def tool_prompts(spark, folder):
    e = table(spark, folder, "session_events").where("session_id IS NOT NULL")
    once = e.groupBy("event_id").agg(F.min(F.struct("session_id", "type", "role", "content")).alias("e")).select("event_id", "e.*")
    return P.tool_prompts(once)


@query(f"WITH {CURRENT} SELECT path, coalesce(title, '') || '. ' || coalesce(summary, '') || chr(10) || chr(10) || left(coalesce(content, ''), 600) AS text FROM page")
def embedding_texts(spark, folder):
    return pages(spark, folder).select("path", P.embedding_text(F.col("title"), F.col("summary"), F.col("content")).alias("text"))


@query(f"WITH {EV}, r AS (SELECT event_id, content FROM ev WHERE starts_with(content, '{{') AND json_valid(content)) SELECT event_id, content->>'type' AS type, content->>'name' AS name FROM r WHERE content->>'type' = 'tool_use' AND content->>'name' IN ('Bash', 'Read', 'Write', 'Edit')")
def reply_labels(spark, folder):
    """Object contents as a model would send them, in a code fence; those with an unknown type or name are no labels."""
    e = events(spark, folder).where("content LIKE '{%'")
    reply = F.concat(F.lit("```json\n"), F.col("content"), F.lit("\n```\n"))
    fields = P.reply_fields(reply, {"type": ("tool_use",), "name": ("Bash", "Read", "Write", "Edit")})
    return e.select("event_id", fields.alias("r")).where("r IS NOT NULL").select("event_id", "r.type", "r.name")


_PARTS = "list_filter([CASE WHEN trim(coalesce(title, '')) <> '' THEN '## Source' || chr(10) || regexp_replace(title, '^\\s+|\\s+$', '', 'g') END, CASE WHEN trim(coalesce(topic, '')) <> '' THEN '## Topic' || chr(10) || regexp_replace(topic, '^\\s+|\\s+$', '', 'g') END, CASE WHEN regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') <> '' THEN '## Text' || chr(10) || regexp_replace(body, '^\\s+|\\s+$', '', 'g') END], lambda x: x IS NOT NULL)"


@query(f"SELECT DISTINCT note_id, array_to_string({_PARTS}, chr(10) || chr(10)) AS prompt FROM notes")
def note_prompts(spark, folder):
    parts = [("Source", F.col("title")), ("Topic", F.col("topic")), ("Text", F.col("body"))]
    return table(spark, folder, "notes").select("note_id", P.sections(parts).alias("prompt")).distinct()


@query("WITH n AS (SELECT source_file, note_id, body, row_number() OVER (PARTITION BY source_file ORDER BY note_id) AS k FROM (SELECT DISTINCT source_file, note_id, body FROM notes WHERE body IS NOT NULL)) SELECT source_file, coalesce(string_agg('### Note ' || k || chr(10) || body, chr(10) || chr(10) ORDER BY k) FILTER (k <= 40), '') AS prompt, count(*) FILTER (k > 40) AS left_out FROM n GROUP BY 1")
def merge_prompts(spark, folder):
    notes = table(spark, folder, "notes").select("source_file", "note_id", "body").distinct()
    return P.merge_prompts(notes, "source_file", "note_id", "body")


@query("""WITH c AS (SELECT DISTINCT topic, note_id FROM notes), r AS (SELECT topic, note_id, min(relevance) AS rank FROM notes WHERE relevance BETWEEN 1 AND 5 GROUP BY 1, 2)
SELECT topic, note_id, row_number() OVER (PARTITION BY topic ORDER BY rank NULLS LAST, note_id)::INT AS position, CASE WHEN rank IS NULL THEN 0.5 ELSE 1.0 / rank END::DOUBLE AS score FROM c LEFT JOIN r USING (topic, note_id)""")
def reranked_notes(spark, folder):
    n = table(spark, folder, "notes")
    ranks = n.where("relevance BETWEEN 1 AND 5").select("topic", "note_id", F.col("relevance").alias("rank"), (F.lit(1.0) / F.col("relevance")).alias("score"))
    return P.reranked(n.select("topic", "note_id", F.col("note_id").alias("place")).distinct(), ranks, "topic", "note_id", "place")
