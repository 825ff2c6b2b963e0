"""Queries: ledgers, coverage, comparison."""

from pyspark.sql import functions as F

from lorebase.functions.hashing import content_hash
from lorebase.functions.numbers import kilobytes
from lorebase.operators import ledgers as L
from lorebase.plans.catalogue import query, table
from lorebase.plans.search import CURRENT, current, pages


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def manifest_latest(spark, folder):
    return L.latest(table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_DAY = "2026-06-01"
_H = "'sha256:' || left(sha256(coalesce(content, '')), 16)"


@query(f"""WITH {CURRENT}, {CURRENT.replace('page AS', 'old AS').replace('FROM pages)', f"FROM pages WHERE updated < '{_DAY}')")}
SELECT f.path, CASE WHEN l.hash IS NULL THEN 'new' WHEN f.hash <> l.hash THEN 'changed' ELSE 'unchanged' END AS status FROM (SELECT path, {_H} AS hash FROM page) f LEFT JOIN (SELECT path, {_H} AS hash FROM old) l USING (path)""")
def manifest_status(spark, folder):
    """The pages against the ledger of a day: what the pages were then."""
    hashed = lambda rows: rows.select("path", content_hash(F.coalesce("content", F.lit(""))).alias("hash"))
    ledger = current(table(spark, folder, "pages").where(F.col("updated") < _DAY))
    return L.status(hashed(pages(spark, folder)), hashed(ledger), "path")


@query("SELECT doc_id, path, round_even(n_chars / 1024.0::DOUBLE, 1) AS size_kb FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_gaps(spark, folder):
    return L.pending(table(spark, folder, "documents").select("doc_id", "path", kilobytes(F.col("n_chars")).alias("size_kb")), table(spark, folder, "labels"), "doc_id")


@query("SELECT CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE 'root' END AS folder, count(*) AS files FROM (SELECT replace(path, 'raw/', '') AS p FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY 1")
def coverage_by_dir(spark, folder):
    gaps = L.pending(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")
    return L.by_folder(gaps, F.replace("path", F.lit("raw/"), F.lit("")))


@query("WITH l AS (SELECT DISTINCT doc_id FROM labels) SELECT count(l.doc_id) AS ingested, count(*) - count(l.doc_id) AS pending, count(DISTINCT source) AS sources FROM documents LEFT JOIN l USING (doc_id)")
def manifest_summary(spark, folder):
    l = table(spark, folder, "labels").select("doc_id", F.lit(1).alias("done")).distinct()
    return table(spark, folder, "documents").join(l, "doc_id", "left").agg(F.count("done").alias("ingested"), (F.count(F.lit(1)) - F.count("done")).alias("pending"), F.count_distinct("source").alias("sources"))


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'rated' ELSE 'unrated' END AS state FROM documents UNION SELECT doc_id, 'rated' FROM labels WHERE doc_id IS NOT NULL")
def label_merge(spark, folder):
    """All documents, replaced by the rated ones."""
    d = table(spark, folder, "documents").select("doc_id", F.lit("unrated").alias("state"))
    return L.merged(d, table(spark, folder, "labels").where("doc_id IS NOT NULL").select("doc_id", F.lit("rated").alias("state")).distinct(), ["doc_id"])


@query("SELECT coalesce(a.d, b.d) AS day, CASE WHEN a.d IS NULL THEN 'right' WHEN b.d IS NULL THEN 'left' ELSE 'both' END AS state FROM (SELECT DISTINCT left(date, 10) AS d FROM notes) a FULL OUTER JOIN (SELECT DISTINCT strftime(updated_at, '%Y-%m-%d') AS d FROM issues) b ON a.d = b.d")
def compare_full_outer(spark, folder):
    a = table(spark, folder, "notes").select(F.substring("date", 1, 10).alias("day"))
    return L.compare(a, table(spark, folder, "issues").select(F.date_format("updated_at", "yyyy-MM-dd").alias("day")), "day")


@query("SELECT day, o_orderkey FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1 AND day NOT IN (SELECT strftime(l_shipdate, '%Y-%m-%d') FROM lineitem)")
def migrate_first_per_date(spark, folder):
    o = table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderdate", "o_orderkey")
    known = table(spark, folder, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return L.pending(L.first_per(o, ["day"], ["o_orderdate", "o_orderkey"]), known, "day").select("day", "o_orderkey")


@query("WITH n AS (SELECT DISTINCT note_id, title, date FROM notes) SELECT note_id, title, date FROM n WHERE date >= '2026-09-01' ORDER BY note_id DESC LIMIT 20")
def recent_or_latest(spark, folder):
    n = table(spark, folder, "notes").select("note_id", "title", "date").distinct()
    return L.recent_or_latest(n, "date", "2026-09-01", "note_id")


@query("SELECT state.name AS state, count(*) AS issues, count(DISTINCT id) AS distinct_issues FROM issues GROUP BY 1")
def batch_counters(spark, folder):
    return table(spark, folder, "issues").groupBy(F.col("state.name").alias("state")).agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("id").alias("distinct_issues"))
