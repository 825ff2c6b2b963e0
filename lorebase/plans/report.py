"""Queries: the usage report, costs, figures of the base, comparison of days."""

from pyspark.sql import functions as F

from lorebase.functions import text as X
from lorebase.operators import report as R
from lorebase.plans.catalogue import query, table
from lorebase.plans.search import CURRENT, pages
from lorebase.plans.usage import _GAP, _SES, EV, STATS, _gaps, _PRICE, _sessions, events


@query(f"""WITH {STATS}, ses AS (SELECT session_id AS id, start_us // 1000000 AS start, end_us // 1000000 AS stop, user_messages AS messages FROM stat),
pair AS (SELECT a.id AS a, b.id AS b FROM ses a JOIN ses b ON (b.start > a.start OR (b.start = a.start AND b.id > a.id)) AND b.start <= a.stop),
who AS (SELECT a AS id FROM pair UNION SELECT b FROM pair), m AS (SELECT coalesce(sum(messages), 0)::BIGINT AS n FROM ses SEMI JOIN who USING (id))
SELECT (SELECT count(*) FROM pair) AS overlap_events, (SELECT count(*) FROM who) AS sessions_involved, n AS overlap_messages, round_even(n * 100.0::DOUBLE / (SELECT sum(messages) FROM ses), 0)::BIGINT AS pct_messages FROM m""")
def parallel_sessions(spark, folder):
    said = events(spark, folder).where("speaker = 'user'").groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))
    ses = _sessions(spark, folder).join(said.withColumnRenamed("session_id", "id"), "id")
    return R.parallel_sessions(ses)


@query(f"WITH {_GAP} SELECT round_even(avg(gap), 1) AS avg_response_time FROM gap")
def mean_response(spark, folder):
    return R.mean_response(_gaps(spark, folder))


@query(f"WITH {STATS}, s AS (SELECT event_id, unnest(regexp_extract_all(t, '(?:^|\\s)/([a-z][a-z0-9-]+)', 1)) AS skill FROM text WHERE speaker = 'user') SELECT skill, count(*) AS n FROM s GROUP BY 1")
def skill_frequency(spark, folder):
    return R.frequencies(R.skills(events(spark, folder)), "skill", "event_id")


@query(f"WITH {EV}, m AS (SELECT model, count(*) AS n, min(event_id) AS f FROM ev WHERE speaker = 'assistant' AND model IS NOT NULL GROUP BY 1) SELECT model, n FROM m ORDER BY n DESC, f LIMIT 3")
def top_models(spark, folder):
    return R.frequencies(events(spark, folder).where("speaker = 'assistant'"), "model", "event_id", 3)


_COST = f"""{STATS}, cost AS (SELECT session_id, strftime(make_timestamp(start_us), '%Y-%m-%d') AS day, (SELECT regexp_extract(max(cwd), '([^/]*)$', 1) FROM session_events e WHERE e.session_id = stat.session_id) AS project, primary_model AS model, input_tokens, output_tokens, user_messages AS prompts,
    round((input_tokens * {_PRICE.format('0.8::DOUBLE', '3.0::DOUBLE', '15.0::DOUBLE')} + output_tokens * {_PRICE.format('4.0::DOUBLE', '15.0::DOUBLE', '75.0::DOUBLE')}) / 1000000, 6) AS cost FROM (SELECT *, primary_model AS model FROM stat) stat)"""


@query(f"WITH {_COST} SELECT count(*) AS sessions, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(prompts)::BIGINT AS prompts, round(sum(cost::DECIMAL(18, 6)), 2)::DOUBLE AS cost FROM cost")
def cost_totals(spark, folder):
    return R.cost_totals(R.session_costs(events(spark, folder)))


@query(f"WITH {_COST} SELECT model, count(*) AS n FROM cost GROUP BY 1")
def cost_models(spark, folder):
    return R.frequencies(R.session_costs(events(spark, folder)), "model", "session_id")


@query(f"WITH {_COST} SELECT session_id, printf('%s [%s] [%s] $%.6f (%d prompts, ', day, coalesce(project, 'unknown'), model, cost, prompts) || format('{{:,}} in / {{:,}} out)', input_tokens, output_tokens) AS line FROM cost ORDER BY cost DESC, session_id LIMIT 5")
def top_costs(spark, folder):
    return R.top_costs(R.session_costs(events(spark, folder)))


@query(f"WITH {_COST} SELECT count(*) AS sessions, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(prompts), 0)::BIGINT AS prompts, round(coalesce(sum(cost::DECIMAL(18, 6)), 0), 2)::DOUBLE AS cost FROM cost WHERE date_diff('day', day::DATE, DATE '2026-03-31') BETWEEN 0 AND 30")
def cost_last_month(spark, folder):
    return R.cost_totals(R.since(R.session_costs(events(spark, folder)), "2026-03-31", 30))


@query(f"""WITH {CURRENT} SELECT count(*) AS pages, coalesce(sum(len(regexp_extract_all(coalesce(content, ''), '\\[\\[([^\\]|#]+)(?:[|#][^\\]]+)?\\]\\]'))), 0)::BIGINT AS wikilinks, (SELECT count(DISTINCT path) FROM documents WHERE path IS NOT NULL) AS ingested,
(SELECT count(*) FROM (SELECT DISTINCT path FROM pages) p WHERE path IS NULL OR path NOT IN (SELECT path FROM documents WHERE path IS NOT NULL)) AS pending FROM page""")
def base_figures(spark, folder):
    return R.base_figures(pages(spark, folder), table(spark, folder, "pages"), table(spark, folder, "documents").where("path IS NOT NULL"))


@query(f"WITH {_SES}, s AS (SELECT strftime(make_timestamp(start * 1000000), '%Y-%m-%d') AS day, arg_max(id, (lpad(start::VARCHAR, 20, '0') || id)) AS session_id FROM ses GROUP BY 1), n AS (SELECT date AS day, max(note_id) AS note_id FROM notes WHERE date IS NOT NULL GROUP BY 1) SELECT day, session_id, note_id, CASE WHEN session_id IS NULL THEN 'note only' WHEN note_id IS NULL THEN 'session only' ELSE 'both' END AS state FROM s FULL JOIN n USING (day)")
def comparison_day(spark, folder):
    ses = _sessions(spark, folder).select(F.col("id").alias("session_id"), F.date_format(F.timestamp_seconds("start"), "yyyy-MM-dd").alias("day"), "start")
    notes = table(spark, folder, "notes").where("date IS NOT NULL").select("note_id", F.col("date").alias("day"))
    return R.comparison_day(ses, notes)


@query("SELECT DISTINCT id, 'https://images.example/prompt/' || replace(url_encode(title), '%2F', '/') || '?width=1024' AS url FROM issues WHERE title IS NOT NULL")
def image_urls(spark, folder):
    return table(spark, folder, "issues").where("title IS NOT NULL").select("id", F.concat(F.lit("https://images.example/prompt/"), X.url_quoted(F.col("title")), F.lit("?width=1024")).alias("url")).distinct()
