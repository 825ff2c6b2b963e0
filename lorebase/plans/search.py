"""Queries: search, lookup, listing, briefing."""

from pyspark.sql import functions as F

from lorebase.operators import search as S
from lorebase.plans.catalogue import query, table

TAGS = "list_filter(regexp_split_to_array(coalesce(tags, ''), '[\\s,]+'), lambda t: t <> '')"
CURRENT = f"""page AS (SELECT * EXCLUDE (rn) FROM (SELECT path, title, tags, summary, updated, content,
    row_number() OVER (PARTITION BY path ORDER BY coalesce(updated, '') DESC, coalesce(content, '') DESC, coalesce(tags, '') DESC, coalesce(title, '') DESC) AS rn FROM pages) WHERE rn = 1)"""
ORDER = ["updated", "content", "tags", "title"]


def current(rows):
    """One row per path; the greatest of (updated, content, tags, title), nulls as empty texts."""
    best = F.max(F.struct(*[F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ORDER], "title", "tags", "summary", "updated", "content")).alias("b")
    return rows.groupBy("path").agg(best).select("path", "b.title", "b.tags", "b.summary", "b.updated", "b.content")


def pages(spark, folder):
    return current(table(spark, folder, "pages"))


def _search_sql(text: str, scope: str = "", limit: int = 10) -> str:
    hit = lambda c: f"coalesce(contains(lower({c}), '{text}'), false)"
    at = f"strpos(lower(coalesce(content, '')), '{text}')"
    return f"""WITH {CURRENT}, top AS (SELECT *, {at} AS p FROM page WHERE ({hit('content')} OR {hit('title')} OR {hit('summary')}) {scope}
    ORDER BY CASE WHEN {hit('title')} THEN 0 ELSE 1 END, updated DESC NULLS LAST, path LIMIT {limit})
    SELECT path, title, tags, summary, CASE WHEN p > 0 THEN regexp_replace(replace(substr(content, greatest(p - 80, 1), p + 160 - greatest(p - 80, 1)), chr(10), ' '), '^\\s+|\\s+$', '', 'g') ELSE '' END AS snippet FROM top"""


@query(_search_sql("checkpoint"))
def text_search(spark, folder):
    return S.search(pages(spark, folder), "checkpoint")


@query(_search_sql("checkpoint", "AND starts_with(path, 'wiki/rag/')"))
def text_search_scoped(spark, folder):
    return S.search(pages(spark, folder), "checkpoint", "rag")


@query(_search_sql("gateway", "AND coalesce(contains(lower(tags), 'streaming'), false)", 20))
def text_search_tag_scope(spark, folder):
    return S.search(pages(spark, folder), "gateway", "streaming", 20)


@query(f"""WITH {CURRENT} SELECT path, title, tags, summary, '' AS snippet FROM page WHERE lower(content) LIKE '%re_ry loop%' OR lower(title) LIKE '%re_ry loop%' OR lower(summary) LIKE '%re_ry loop%'
ORDER BY CASE WHEN lower(title) LIKE '%re_ry loop%' THEN 0 ELSE 1 END, updated DESC NULLS LAST, path LIMIT 10""")
def text_search_like_wildcard(spark, folder):
    return S.search(pages(spark, folder), "re_ry loop", wildcards=True)


_TERMS = "hybrid retry loop ms"
_SCORE = " + ".join(f"{w} * CAST(coalesce(contains(lower({c}), '{t}'), false) AS INT)" for t in ("hybrid", "retry", "loop") for c, w in (("title", 3), ("summary", 2), ("content", 1)))


@query(f"""WITH {CURRENT}, s AS (SELECT *, {_SCORE} AS score FROM page) SELECT path, title, summary, score, replace(substr(coalesce(content, ''), 1, 200), chr(10), ' ') AS excerpt FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 8""")
def term_score(spark, folder):
    return S.term_search(pages(spark, folder), _TERMS)


@query(f"""WITH {CURRENT} SELECT path, coalesce(title, regexp_extract(path, '([^/]*)\\.md$', 1)) AS title, array_to_string({TAGS}, ', ') AS tags, coalesce(summary, '') AS summary FROM page WHERE list_contains({TAGS}, 'streaming')""")
def list_pages_by_tag(spark, folder):
    return S.list_pages(pages(spark, folder), tag="streaming")


@query(f"""WITH {CURRENT} SELECT path, coalesce(title, regexp_extract(path, '([^/]*)\\.md$', 1)) AS title, CASE WHEN len({TAGS}) = 0 THEN 'none' ELSE array_to_string({TAGS}, ', ') END AS tags, coalesce(summary, '') AS summary FROM page WHERE split_part(path, '/', -2) = 'deep-agents'""")
def list_pages_by_folder(spark, folder):
    return S.list_pages(pages(spark, folder), folder="Deep_Agents")


_TYPE = f"coalesce(list_filter({TAGS}, lambda t: t IN ('concept','pattern','decision','project','comparison','reference','conflict'))[1], 'concept')"


@query(f"""WITH {CURRENT}, l AS (SELECT split_part(path, '/', -2) AS domain, coalesce(CASE {_TYPE} WHEN 'decision' THEN 0 WHEN 'pattern' THEN 1 WHEN 'comparison' THEN 2 WHEN 'concept' THEN 3 WHEN 'reference' THEN 4 WHEN 'project' THEN 5 END, 9) AS r,
    coalesce(title, regexp_extract(path, '([^/]*)\\.md$', 1)) AS t, path, concat_ws(': ', title, summary) AS line FROM page)
SELECT domain, count(*) AS pages, string_agg(line, chr(10) ORDER BY r, t, path) AS briefing FROM l GROUP BY domain""")
def domain_briefing(spark, folder):
    return S.briefing(pages(spark, folder), S.parent_folder(F.col("path")))


@query(f"WITH {CURRENT} SELECT path, {_TYPE} AS page_type, split_part(path, '/', -2) AS domain FROM page")
def first_match_type(spark, folder):
    return pages(spark, folder).select("path", S.first_type(S.tag_list(F.col("tags"))).alias("page_type"), S.parent_folder(F.col("path")).alias("domain"))


@query(f"""WITH {CURRENT}, r AS (SELECT path, title, content, CASE WHEN contains(regexp_extract(lower(path), '([^/]*)\\.md$', 1), 'persona-card') THEN 3 WHEN contains(regexp_extract(lower(path), '([^/]*)\\.md$', 1), 'persona') THEN 4 END AS rank FROM page)
SELECT rank, path, title, content FROM r WHERE rank = (SELECT min(rank) FROM r) ORDER BY string_split(path, '/') LIMIT 10""")
def page_lookup(spark, folder):
    return S.read_page(pages(spark, folder), "Persona Card")


@query(f"""WITH {CURRENT} SELECT regexp_extract(path, '([^/]*)\\.md$', 1) AS id, path, coalesce(title, regexp_extract(path, '([^/]*)\\.md$', 1)) AS title, array_to_string({TAGS}, ' ') AS tags, coalesce(summary, '') AS summary, coalesce(updated, '') AS updated FROM page""")
def index_rows(spark, folder):
    return S.index_of(pages(spark, folder))


@query(f"""WITH {CURRENT}, t AS (SELECT path, title, {TAGS} AS ts, {_TYPE} AS kind FROM page) SELECT path, title FROM t WHERE list_has_any(ts, ['voice', 'memory']) AND kind IN ('pattern', 'decision')""")
def tag_and_type_filter(spark, folder):
    return S.selected(pages(spark, folder), ("voice", "memory"), ("pattern", "decision")).select("path", "title")


@query(f"""WITH {CURRENT}, t AS (SELECT path, coalesce(title, regexp_extract(path, '([^/]*)\\.md$', 1)) AS t, summary, content, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS stem FROM page),
r AS (SELECT *, CASE WHEN stem = 'choosing-a-guardrail' THEN 1 WHEN lower(t) = 'choosing a guardrail' AND NOT starts_with(split_part(path, '/', -1), '_') THEN 2 END AS rank FROM t)
SELECT rank, path, '# ' || t || chr(10) || chr(10) || 'Summary: ' || coalesce(summary, '') || chr(10) || chr(10) || coalesce(content, '') AS text FROM r WHERE rank IS NOT NULL ORDER BY rank, string_split(path, '/') LIMIT 1""")
def page_by_id(spark, folder):
    return S.page_by_id(pages(spark, folder), "choosing-a-guardrail")


@query(f"""WITH {CURRENT}, t AS (SELECT path, coalesce(title, regexp_extract(path, '([^/]*)\\.md$', 1)) AS title, array_to_string({TAGS}, ' ') AS tags FROM page) SELECT * FROM t WHERE contains(lower(title), 'stream') OR contains(tags, 'stream')""")
def dashboard_search(spark, folder):
    return S.dashboard_search(pages(spark, folder), "Stream")
