"""Queries: string, hash, date functions and front matter."""

from pyspark.sql import functions as F

from lorebase.functions import frontmatter as M
from lorebase.functions import hashing as H
from lorebase.functions import text as X
from lorebase.operators import vectors as V
from lorebase.plans.catalogue import query, table


@query(r"""SELECT doc_id, replace(regexp_replace(lower(title), '^\s+|\s+$', '', 'g'), ' ', '-') AS slug_a,
regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug_b,
regexp_replace(left(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 40), '^-+|-+$', '', 'g') AS slug_c,
left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug_u FROM documents WHERE title IS NOT NULL""")
def slugs(spark, folder):
    t = F.col("title")
    return table(spark, folder, "documents").where("title IS NOT NULL").select("doc_id", X.slug_words(t).alias("slug_a"), X.slug_dashes(t).alias("slug_b"), X.slug_short(t).alias("slug_c"), X.slug_short(t, 60, False).alias("slug_u"))


@query(r"""SELECT part.p_partkey, concat(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9\s-]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), 80), '-+$', ''), '.md') AS slug_d,
left(regexp_replace(lower(p_name || ' / ' || p_type), '[^\w]+', '_', 'g'), 40) AS slug_e FROM part""")
def file_slugs(spark, folder):
    p = table(spark, folder, "part")
    return p.select("p_partkey", X.slug_file(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug_d"), X.slug_underscores(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug_e"))


@query(r"""SELECT event_id, unnest(regexp_extract_all(content, '(?:^|\s)/([a-z][a-z0-9-]+)', 1)) AS command FROM session_events WHERE content IS NOT NULL""")
def slash_commands(spark, folder):
    return table(spark, folder, "session_events").where("content IS NOT NULL").select("event_id", F.explode(X.slash_commands(F.col("content"))).alias("command"))


@query(r"""SELECT event_id, regexp_replace(content, '<[^>]+>.*?</[^>]+>', '', 'gs') AS bare FROM session_events WHERE contains(content, '</')""")
def without_elements(spark, folder):
    return table(spark, folder, "session_events").where(F.contains("content", F.lit("</"))).select("event_id", X.without_elements(F.col("content")).alias("bare"))


@query("""SELECT doc_id, 'sha256:' || left(sha256(text), 16) AS hash, left(sha1(path), 8) AS path_hash FROM documents WHERE text IS NOT NULL""")
def content_hash(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", H.content_hash(F.col("text")).alias("hash"), H.url_hash(F.col("path")).alias("path_hash"))


@query("""SELECT arg_min(doc_id, -q * 10000000000 + doc_id) AS doc_id, count(*) AS copies FROM (SELECT d.doc_id, text, coalesce(q, -1) AS q FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id WHERE text IS NOT NULL) GROUP BY 'sha256:' || left(sha256(text), 16)""")
def dedup_by_hash(spark, folder):
    rated = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, folder, "documents").where("text IS NOT NULL").join(rated, "doc_id", "left")
    return V.best_per(docs, H.content_hash(F.col("text")), "quality", "doc_id")


@query(r"""WITH u AS (SELECT DISTINCT url FROM issues) SELECT url, replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS host, left(sha1(url), 8) AS url_hash, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM u""")
def url_slug_host(spark, folder):
    u = F.col("url")
    return table(spark, folder, "issues").select("url").distinct().select("url", X.url_host(u).alias("host"), H.url_hash(u).alias("url_hash"), X.slug_short(u, 60, False).alias("slug"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.-]+', '[EMAIL]', 'g'), '\b\d{1,3}(\.\d{1,3}){3}\b', '[IP]', 'g') AS text FROM (SELECT DISTINCT note_id AS doc_id, body AS text FROM notes) WHERE regexp_matches(text, '[\w.+-]+@[\w-]+\.[\w.-]+|\b\d{1,3}(\.\d{1,3}){3}\b')""")
def pii_redact(spark, folder):
    notes = table(spark, folder, "notes").select(F.col("note_id").alias("doc_id"), F.col("body").alias("text")).distinct()
    return notes.where(F.col("text").rlike(r"[\w.+-]+@[\w-]+\.[\w.-]+|\b\d{1,3}(\.\d{1,3}){3}\b")).select("doc_id", X.redact_simple(F.col("text")).alias("text"))


_FM = r"""WITH f AS (SELECT path, content, CASE WHEN starts_with(content, '---') AND strpos(substr(content, 4), '---') > 0 THEN split_part(substr(content, 4), '---', 1) ELSE '' END AS block FROM pages)"""


@query(_FM + r""", l AS (SELECT DISTINCT path, regexp_extract(block, '(?m)^title:[ \t]*(.*?)\s*$', 1) AS title, regexp_extract(block, '(?m)^tags:[ \t]*(.*?)\s*$', 1) AS tags FROM f WHERE block <> '')
SELECT path, title, array_to_string(regexp_extract_all(tags, '([\w-]+)', 1), ' ') AS tags FROM l""")
def frontmatter_index(spark, folder):
    c = F.col("content")
    p = table(spark, folder, "pages").where(M.index_block(c) != "")
    return p.select("path", F.coalesce(M.index_fields(c)["title"], F.lit("")).alias("title"), F.array_join(M.index_tags(c), " ").alias("tags")).distinct()


@query(r"""WITH f AS (SELECT path, CASE WHEN starts_with(content, '---') AND strpos(substr(content, 4), chr(10) || '---') > 0 THEN split_part(substr(content, 4), chr(10) || '---', 1) ELSE '' END AS block FROM pages),
v AS (SELECT DISTINCT path, regexp_extract(block, '(?m)^tags:[ \t]*\[(.*)\]\s*$', 1) AS tags, nullif(regexp_extract(block, '(?m)^updated:[ \t]*(.*?)\s*$', 1), '') AS updated FROM f WHERE block <> '')
SELECT path, updated, len(list_filter(string_split(tags, ','), lambda x: trim(x) <> '')) AS n_tags FROM v""")
def frontmatter_note(spark, folder):
    c = F.col("content")
    p = table(spark, folder, "pages").where(M.note_block(c) != "")
    return p.select("path", M.note_fields(c)["updated"].alias("updated"), F.size(M.note_list(M.note_fields(c)["tags"])).cast("long").alias("n_tags")).distinct()


@query(r"""SELECT note_id, lower(regexp_extract_all(body, '#([a-zA-Z][a-zA-Z0-9_-]*)', 1)[1]) AS first_tag, CASE WHEN regexp_matches(body, 'Relevance:\s*(\d)/5') THEN least(greatest(try_cast(regexp_extract(body, 'Relevance:\s*(\d)/5', 1) AS INT), 1), 5) ELSE 3 END AS relevance FROM (SELECT DISTINCT note_id, body FROM notes WHERE body IS NOT NULL)""")
def note_relevance(spark, folder):
    n = table(spark, folder, "notes").where("body IS NOT NULL").select("note_id", "body").distinct()
    return n.select("note_id", F.try_element_at(X.inline_tags(F.col("body")), F.lit(1)).alias("first_tag"), X.relevance_of(F.col("body")).alias("relevance"))


@query(r"""SELECT event_id, CASE lower(regexp_extract(p, '[^/]\.([^./]+)$', 1)) WHEN 'md' THEN 'Markdown' WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'json' THEN 'JSON' WHEN 'yaml' THEN 'YAML' WHEN 'sh' THEN 'Shell' WHEN 'sql' THEN 'SQL' WHEN 'toml' THEN 'TOML' WHEN 'html' THEN 'HTML' WHEN 'css' THEN 'CSS' WHEN 'ipynb' THEN 'Notebook' WHEN 'js' THEN 'JavaScript' WHEN 'tsx' THEN 'TypeScript' WHEN 'jsx' THEN 'JavaScript' WHEN 'yml' THEN 'YAML' WHEN 'bash' THEN 'Shell' END AS language
FROM (SELECT event_id, regexp_extract(content, '"(?:file_path|path)": "([^"]+)"', 1) AS p FROM session_events WHERE regexp_matches(content, '"(?:file_path|path)": "'))""")
def file_languages(spark, folder):
    e = table(spark, folder, "session_events").where(F.col("content").rlike(r'"(?:file_path|path)": "'))
    return e.select("event_id", X.language_of(F.regexp_extract("content", r'"(?:file_path|path)": "([^"]+)"', 1)).alias("language"))
