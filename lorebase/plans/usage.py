"""Queries: usage analytics. Events are taken once per event_id."""

from pyspark.sql import functions as F

from lorebase.functions import numbers as N
from lorebase.functions import text as X
from lorebase.operators import usage as U
from lorebase.plans.catalogue import query, table

EV = """ev AS (SELECT * EXCLUDE (rn) FROM (SELECT event_id, session_id, type, model, content, usage.input_tokens AS tin, usage.output_tokens AS tout, CASE WHEN lower(type) = 'message' THEN lower(role) WHEN lower(type) IN ('user', 'assistant') THEN lower(type) END AS speaker,
    CASE WHEN regexp_matches(timestamp, '^\\d{13}$') THEN timestamp::BIGINT * 1000 ELSE epoch_us(try_cast(timestamp AS TIMESTAMPTZ)) END AS ats, row_number() OVER (PARTITION BY event_id ORDER BY event_id) AS rn FROM session_events WHERE session_id IS NOT NULL) WHERE rn = 1)"""
BLOCKS = EV + """, blk AS (SELECT session_id, event_id, speaker, type, unnest(from_json(content, '["JSON"]')) AS b FROM ev WHERE starts_with(content, '[') AND json_valid(content)
    UNION ALL SELECT session_id, event_id, speaker, type, content::JSON FROM ev WHERE starts_with(content, '{') AND json_valid(content)),
call AS (SELECT session_id, event_id, coalesce(b->>'name', 'unknown') AS name, coalesce(b->'input'->>'file_path', b->'input'->>'path') AS path, b->'input'->>'command' AS command FROM blk WHERE b->>'type' = 'tool_use')"""


def events(spark, folder):
    """One row per event_id: the least of its deliveries, with the working directory of any of them that has one."""
    rest = F.min(F.struct("session_id", "type", "role", "timestamp", "model", "content", "usage")).alias("e")
    e = table(spark, folder, "session_events").where("session_id IS NOT NULL").groupBy("event_id").agg(rest, F.max("cwd").alias("cwd")).select("event_id", "cwd", "e.*")
    speaker = F.when(F.lower("type") == "message", F.lower("role")).when(F.lower("type").isin("user", "assistant"), F.lower("type"))
    at = F.when(F.col("timestamp").rlike(r"^\d{13}$"), F.col("timestamp").try_cast("bigint") * 1000).when(F.col("timestamp").rlike(r"^\d{4}-"), F.unix_micros(F.when(F.col("timestamp").rlike(r"([Zz]|[+-]\d{2}:\d{2})$"), F.col("timestamp")).otherwise(F.concat("timestamp", F.lit("Z"))).try_cast("timestamp")))
    return e.select("event_id", "session_id", "type", "cwd", "model", "content", "usage", speaker.alias("speaker"), at.alias("at"))


@query(f"""WITH {EV} SELECT session_id, min(ats) FILTER (speaker = 'user') AS start_us, count(*) FILTER (speaker = 'user') AS user_messages, count(*) FILTER (speaker = 'assistant') AS assistant_messages,
    coalesce(sum(tin) FILTER (speaker = 'assistant'), 0)::BIGINT AS input_tokens, coalesce(sum(tout) FILTER (speaker = 'assistant'), 0)::BIGINT AS output_tokens,
    round_even((max(ats) FILTER (speaker = 'user') - min(ats) FILTER (speaker = 'user')) / 6e7::DOUBLE, 1) AS duration_minutes,
    count(DISTINCT CASE WHEN type = 'file-history-snapshot' AND json_valid(content) THEN content->>'fileId' END) AS files_modified
FROM ev GROUP BY session_id HAVING min(ats) FILTER (speaker = 'user') IS NOT NULL""")
def session_msg_stats(spark, folder):
    return U.message_statistics(events(spark, folder)).select("session_id", "start_us", "user_messages", "assistant_messages", "input_tokens", "output_tokens", "duration_minutes", "files_modified")


@query(f"WITH {BLOCKS} SELECT session_id, name, count(*) AS n FROM call GROUP BY 1, 2")
def session_count_map(spark, folder):
    m = U.count_map(U.tool_calls(events(spark, folder)), "session_id", "name", "counts")
    return m.select("session_id", F.explode("counts").alias("name", "n"))


@query(f"WITH {BLOCKS} SELECT name, count(*) AS n FROM call GROUP BY 1")
def tool_totals(spark, folder):
    m = U.count_map(U.tool_calls(events(spark, folder)), "session_id", "name", "counts")
    return U.merge_maps(m, "counts").withColumnRenamed("key", "name")


_CLS = "CASE WHEN contains(c, 'no such file') OR contains(c, 'not found') THEN 'file_not_found' WHEN contains(c, 'permission') THEN 'permission_denied' WHEN contains(c, 'rejected') THEN 'user_rejected' WHEN contains(c, 'failed') OR contains(c, 'exit code') THEN 'command_failed' WHEN contains(c, 'too large') OR contains(c, 'too long') THEN 'file_too_large' WHEN contains(c, 'edit') THEN 'edit_failed' ELSE 'other' END"


@query(f"WITH {BLOCKS}, f AS (SELECT lower(coalesce(b->>'content', '')) AS c FROM blk WHERE b->>'type' = 'tool_result' AND b->>'is_error' = 'true') SELECT {_CLS} AS class, count(*) AS n FROM f GROUP BY 1")
def error_classes(spark, folder):
    return U.tool_failures(events(spark, folder)).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1")
def primary_type(spark, folder):
    return U.primary(table(spark, folder, "events"), "user_id", "event_type", "event_id")


_GAP = EV + ", g AS (SELECT session_id, (ats - lag(ats) OVER (PARTITION BY session_id ORDER BY ats)) / 1e6::DOUBLE AS gap FROM ev WHERE speaker = 'user' AND ats IS NOT NULL), gap AS (SELECT * FROM g WHERE gap > 1 AND gap < 7200)"


def _gaps(spark, folder):
    return U.gaps(events(spark, folder).where("speaker = 'user' AND at IS NOT NULL"), "session_id", "at")


@query(f"WITH {_GAP} SELECT session_id, gap FROM gap")
def response_gaps(spark, folder):
    return _gaps(spark, folder)


@query(f"WITH {_GAP}, d AS (SELECT unnest(['2-10s', '10-30s', '30s-1m', '1-2m', '2-5m', '5-15m', '>15m']) AS bucket), c AS (SELECT CASE WHEN gap < 10 THEN '2-10s' WHEN gap < 30 THEN '10-30s' WHEN gap < 60 THEN '30s-1m' WHEN gap < 120 THEN '1-2m' WHEN gap < 300 THEN '2-5m' WHEN gap < 900 THEN '5-15m' ELSE '>15m' END AS bucket, count(*) AS n FROM gap GROUP BY 1) SELECT bucket, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (bucket)")
def response_histogram(spark, folder):
    return U.response_histogram(_gaps(spark, folder))


@query(f"WITH {_GAP}, o AS (SELECT list(gap ORDER BY gap) AS v FROM gap) SELECT v[floor(len(v) * 0.5)::BIGINT + 1] AS median, v[floor(len(v) * 0.75)::BIGINT + 1] AS p75, v[floor(len(v) * 0.9)::BIGINT + 1] AS p90 FROM o")
def index_percentiles(spark, folder):
    return U.rank_percentiles(_gaps(spark, folder), "gap", {"median": 0.5, "p75": 0.75, "p90": 0.9})


@query("SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def hour_histogram(spark, folder):
    return table(spark, folder, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(DISTINCT ts::DATE) AS days, round_even(count(*)::DOUBLE / count(DISTINCT ts::DATE), 1) AS per_day, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY 1")
def days_active(spark, folder):
    e = table(spark, folder, "events")
    return e.groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.bround(F.count(F.lit(1)) / F.count_distinct(F.to_date("ts")), 1).alias("per_day"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


_SES = EV + ", ses AS (SELECT session_id AS id, min(ats) // 1000000 AS start, max(ats) // 1000000 AS stop FROM ev WHERE ats IS NOT NULL AND speaker = 'user' GROUP BY 1)"


def _sessions(spark, folder):
    e = events(spark, folder).where("at IS NOT NULL AND speaker = 'user'")
    return e.groupBy(F.col("session_id").alias("id")).agg(F.floor(F.min("at") / 1000000).alias("start"), F.floor(F.max("at") / 1000000).alias("stop"))


@query(f"WITH {_SES} SELECT a.id AS a, b.id AS b FROM ses a JOIN ses b ON (b.start > a.start OR (b.start = a.start AND b.id > a.id)) AND b.start <= a.stop")
def overlap_sessions(spark, folder):
    return U.overlaps(_sessions(spark, folder))


_PRICE = "CASE WHEN starts_with(model, 'harrow-lite') THEN {0} WHEN starts_with(model, 'harrow') THEN {1} WHEN starts_with(model, 'mallow') THEN {2} ELSE {1} END"


@query(f"WITH {EV} SELECT session_id, round(sum(coalesce(tin, 0) * {_PRICE.format(0.8, 3.0, 15.0)} + coalesce(tout, 0) * {_PRICE.format(4.0, 15.0, 75.0)})::DOUBLE / 1000000, 6) AS cost, count(*) AS calls FROM ev WHERE speaker = 'assistant' AND model IS NOT NULL GROUP BY 1")
def cost_by_session(spark, folder):
    e = events(spark, folder).where("speaker = 'assistant' AND model IS NOT NULL")
    micro = lambda c, i: F.coalesce(F.col(c), F.lit(0)) * N.price_of(F.col("model"), i).cast("decimal(10,2)")
    return e.groupBy("session_id").agg(F.round(F.sum(micro("usage.input_tokens", 0) + micro("usage.output_tokens", 1)).cast("double") / 1000000, 6).alias("cost"), F.count(F.lit(1)).alias("calls"))


@query("SELECT coalesce(lang, 'none') AS lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def facet_counts(spark, folder):
    return table(spark, folder, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query(f"WITH {BLOCKS} SELECT session_id, count(*) AS calls, count(*) FILTER (regexp_matches(command, '\\bcat\\s+\\S|\\bhead\\s|\\btail\\s|\\bsed\\s|\\bawk\\s|\\bgrep\\s|\\brg\\s|\\bfind\\s+\\.|\\bls\\s|\\bwc\\s')) AS misuses FROM call WHERE name = 'Bash' GROUP BY 1")
def shell_misuse(spark, folder):
    return U.tool_calls(events(spark, folder)).where("name = 'Bash'").groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("command").rlike(U.SHELL_MISUSE)).alias("misuses"))


@query(f"WITH {_SES}, n AS (SELECT session_id, count(*) AS tokens FROM ev GROUP BY 1), m AS (SELECT id AS session_id, tokens, strftime(to_timestamp(start) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS minute FROM ses JOIN n ON n.session_id = ses.id), note AS (SELECT session_id AS note, CASE WHEN hash_id % 2 = 0 THEN session_id END AS session_id, minute FROM (SELECT *, ascii(session_id) AS hash_id FROM m)), bm AS (SELECT minute, min(session_id) AS s FROM m GROUP BY 1) SELECT note, coalesce(a.tokens, b.tokens) AS tokens, CASE WHEN a.tokens IS NOT NULL THEN 'id' WHEN b.tokens IS NOT NULL THEN 'minute' ELSE 'none' END AS matched FROM note LEFT JOIN m a ON a.session_id = note.session_id LEFT JOIN bm ON note.session_id IS NULL AND bm.minute = note.minute LEFT JOIN m b ON b.session_id = bm.s")
def enrich_fallback(spark, folder):
    n = events(spark, folder).groupBy("session_id").agg(F.count(F.lit(1)).alias("tokens"))
    meta = _sessions(spark, folder).withColumnRenamed("id", "session_id").join(n, "session_id").select("session_id", "tokens", F.date_format(F.timestamp_seconds("start"), "yyyy-MM-dd HH:mm").alias("minute"))
    notes = meta.select(F.col("session_id").alias("note"), F.when(F.ascii("session_id") % 2 == 0, F.col("session_id")).alias("session_id"), "minute")
    return U.enriched(notes, meta).select("note", "tokens", "matched")


STATS = BLOCKS.replace("WITH ", "") + f""", proj AS (SELECT session_id, min(cwd) AS project_path FROM (SELECT event_id, min(session_id) AS session_id, max(cwd) AS cwd FROM session_events WHERE session_id IS NOT NULL GROUP BY 1) GROUP BY 1),
text AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN starts_with(content, '[{{') THEN CASE WHEN json_valid(content) THEN array_to_string(list_transform(list_filter(from_json(content, '["JSON"]'), lambda b: b->>'type' IN ('text', 'input_text', 'output_text')), lambda b: coalesce(b->>'text', '')), ' ') ELSE '' END
    WHEN starts_with(content, '{{') THEN CASE WHEN json_valid(content) AND content->>'type' IN ('text', 'input_text', 'output_text') THEN coalesce(content->>'text', '') ELSE '' END ELSE coalesce(content, '') END, '<[^>]+>.*?</[^>]+>', '', 'gs'), '^\\s+|\\s+$', '', 'g') AS t FROM ev),
made AS (SELECT session_id, count(*) FILTER (name = 'Bash' AND regexp_matches(command, '\\bcat\\s+\\S|\\bhead\\s|\\btail\\s|\\bsed\\s|\\bawk\\s|\\bgrep\\s|\\brg\\s|\\bfind\\s+\\.|\\bls\\s|\\bwc\\s')) AS shell_misuses, count(*) FILTER (name = 'Task') AS task_calls, count(*) FILTER (name = 'TodoWrite') AS todo_calls,
    count(*) FILTER (name = 'Read') AS reads, count(*) FILTER (name IN ('Edit', 'Write', 'MultiEdit')) AS edits, count(*) AS calls, count(*) FILTER (name = 'Bash') AS bash
    FROM (SELECT session_id, coalesce(b->>'name', 'unknown') AS name, b->'input'->>'command' AS command FROM blk WHERE b->>'type' = 'tool_use' AND (speaker = 'assistant' OR type = 'tool_call')) GROUP BY 1),
skill AS (SELECT session_id, sum(len(regexp_extract_all(t, '(?:^|\\s)/([a-z][a-z0-9-]+)', 1)))::BIGINT AS skill_calls FROM text WHERE speaker = 'user' GROUP BY 1),
g AS (SELECT session_id, (ats - lag(ats) OVER (PARTITION BY session_id ORDER BY ats)) / 1e6::DOUBLE AS gap FROM ev WHERE speaker = 'user' AND ats IS NOT NULL),
wait AS (SELECT session_id, count(*) AS responses, count(*) FILTER (gap < 5) AS interruptions FROM g WHERE gap > 1 AND gap < 7200 GROUP BY 1),
used AS (SELECT session_id, model, count(*) AS n, min(event_id) AS f FROM ev WHERE speaker = 'assistant' AND model <> '' GROUP BY 1, 2),
main AS (SELECT session_id, arg_max(model, n * 10000000000 - f) AS primary_model FROM used GROUP BY 1),
fail AS (SELECT session_id, count(*) FILTER (class IN ('edit_failed', 'file_not_found')) AS failures FROM (SELECT session_id, {_CLS} AS class FROM (SELECT session_id, lower(coalesce(b->>'content', '')) AS c FROM blk WHERE b->>'type' = 'tool_result' AND b->>'is_error' = 'true')) GROUP BY 1),
base AS (SELECT session_id, min(ats) FILTER (speaker = 'user') AS start_us, max(ats) FILTER (speaker = 'user') AS end_us, count(*) FILTER (speaker = 'user') AS user_messages, count(*) FILTER (speaker = 'assistant') AS assistant_messages,
    coalesce(sum(tin) FILTER (speaker = 'assistant'), 0)::BIGINT AS input_tokens, coalesce(sum(tout) FILTER (speaker = 'assistant'), 0)::BIGINT AS output_tokens FROM ev GROUP BY 1 HAVING start_us IS NOT NULL),
stat AS (SELECT base.*, project_path, coalesce(shell_misuses, 0) AS shell_misuses, coalesce(task_calls, 0) AS task_calls, coalesce(todo_calls, 0) AS todo_calls, coalesce(reads, 0) AS reads, coalesce(edits, 0) AS edits, coalesce(calls, 0) AS calls, coalesce(bash, 0) AS bash, coalesce(skill_calls, 0) AS skill_calls,
    coalesce(responses, 0) AS responses, coalesce(interruptions, 0) AS interruptions, coalesce(primary_model, 'unknown') AS primary_model, coalesce(failures, 0) AS failures, round_even((end_us - start_us) / 6e7::DOUBLE, 1) AS duration_minutes,
    round_even(output_tokens / nullif(assistant_messages, 0)::DOUBLE, 1) AS output_tokens_per_msg, round_even(coalesce(reads, 0) / nullif(coalesce(edits, 0), 0)::DOUBLE, 2) AS read_edit_ratio
    FROM base LEFT JOIN proj USING (session_id) LEFT JOIN made USING (session_id) LEFT JOIN skill USING (session_id) LEFT JOIN wait USING (session_id) LEFT JOIN main USING (session_id) LEFT JOIN fail USING (session_id))"""
_PLAIN = ["session_id", "project_path", "start_us", "end_us", "user_messages", "assistant_messages", "input_tokens", "output_tokens", "shell_misuses", "task_calls", "todo_calls", "reads", "edits", "skill_calls", "responses", "interruptions", "primary_model", "duration_minutes", "output_tokens_per_msg", "read_edit_ratio"]


@query(f"WITH {STATS} SELECT {', '.join(_PLAIN)} FROM stat")
def session_stats(spark, folder):
    return U.session_statistics(events(spark, folder)).select(*_PLAIN)


@query(f"""WITH {STATS}, s AS (SELECT session_id, list_filter([CASE WHEN failures > 2 THEN 'repeated tool failures' END, CASE WHEN bash / greatest(calls, 1)::DOUBLE > 0.6 THEN 'high shell usage' END, CASE WHEN interruptions > 3 THEN 'frequent interruptions' END], lambda x: x IS NOT NULL) AS x FROM stat)
SELECT session_id, CASE WHEN len(x) = 0 THEN '- [ ] None detected' ELSE array_to_string(list_transform(x, lambda i: '- [ ] ' || i), chr(10)) END AS signals FROM s""")
def friction_signals(spark, folder):
    return U.friction(U.session_statistics(events(spark, folder))).select("session_id", X.checklist(F.col("signals")).alias("signals"))


@query(f"WITH {STATS} SELECT count(*) AS sessions, sum(user_messages)::BIGINT AS user_messages, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(DISTINCT start_us // 86400000000) AS days_active, count(*) FILTER (task_calls > 0) AS task_agent_sessions, count(*) FILTER (duration_minutes > 30 AND todo_calls = 0) AS long_without_todo, count(*) FILTER (read_edit_ratio < 1) AS ratio_below_1 FROM stat")
def usage_totals(spark, folder):
    return U.totals(U.session_statistics(events(spark, folder)))


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s) SELECT user_id, s::BIGINT AS session, count(*) AS events, epoch_us(min(ts)) AS start_us FROM g GROUP BY 1, 2")
def gap_sessions(spark, folder):
    e = table(spark, folder, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    return U.sessions_by_silence(e, "user_id", "at", "event_id", 6 * 3600 * 1_000_000)
