"""Queries: chunk plans and chunkers."""

from pyspark.sql import functions as F

from lorebase.operators import chunks as C
from lorebase.plans.catalogue import query, table

# pages of a document: 100 characters each, so that some exceed the limit
DOC = "d AS (SELECT doc_id, greatest(ceil(n_chars / 100.0)::BIGINT, 1) AS pages FROM documents WHERE n_chars IS NOT NULL)"


def _docs(spark, folder):
    return table(spark, folder, "documents").where("n_chars IS NOT NULL").select("doc_id", F.greatest(F.ceil(F.col("n_chars") / 100.0), F.lit(1)).cast("bigint").alias("pages"))


@query(f"WITH {DOC} SELECT doc_id, s AS start_page, least(s + 19, pages) AS end_page, 'Part ' || ((s - 1) // 20 + 1) AS title FROM (SELECT doc_id, pages, unnest(range(1, pages + 1, 20)) AS s FROM d)")
def chunk_hard_split(spark, folder):
    return C.hard_split(_docs(spark, folder), "doc_id", "pages")


SEC = "sec AS (SELECT source_file, start_page AS page, min(title) AS title, max(greatest(start_page, end_page)) OVER (PARTITION BY source_file) AS pages FROM (SELECT DISTINCT source_file, start_page, end_page, title FROM chunks WHERE start_page IS NOT NULL AND end_page IS NOT NULL AND source_file IS NOT NULL) GROUP BY source_file, start_page, end_page), one AS (SELECT source_file, page, min(title) AS title, max(pages) AS pages FROM sec GROUP BY 1, 2)"


@query(f"WITH {SEC}, e AS (SELECT source_file, page, title, coalesce(lead(page) OVER (PARTITION BY source_file ORDER BY page) - 1, pages) AS stop FROM one), p AS (SELECT *, unnest(range(page, stop + 1, 20)) AS s FROM e WHERE stop >= page) SELECT source_file, s::BIGINT AS start_page, least(s + 19, stop)::BIGINT AS end_page, CASE WHEN stop - page + 1 <= 20 THEN title ELSE title || ' (Part ' || ((s - page) // 20 + 1) || ')' END AS title FROM p")
def chunk_sections(spark, folder):
    c = table(spark, folder, "chunks").where("start_page IS NOT NULL AND end_page IS NOT NULL AND source_file IS NOT NULL")
    last = c.groupBy("source_file").agg(F.max(F.greatest("start_page", "end_page")).alias("pages"))
    one = c.groupBy("source_file", F.col("start_page").alias("page")).agg(F.min("title").alias("title"))
    return C.section_split(one.join(last, "source_file"), "source_file", "pages")


@query("""SELECT v.doc AS doc, c.s AS start_page, c.e AS end_page, c.t AS title FROM (VALUES
    ('a', 1, 12, 'Full Document'), ('b', 1, 20, 'Part 1'), ('b', 21, 40, 'Part 2'), ('b', 41, 41, 'Part 3'), ('c', 3, 9, 'Chapter 1: Start'), ('c', 10, 29, '2. Middle (Part 1)'), ('c', 30, 39, '2. Middle (Part 2)'), ('c', 40, 45, '3 Ending')) AS c(d, s, e, t) JOIN (VALUES ('a'), ('b'), ('c')) AS v(doc) ON c.d = v.doc""")
def chunk_plan(spark, folder):
    docs = spark.createDataFrame([("a", "Chapter 1 Intro 3", 12), ("b", "nothing here", 41), ("c", "Chapter 1: Start 3\n2. Middle 10\n3 Ending 40\n9. Beyond 99", 45)], "doc string, toc string, pages int")
    return C.plan(docs, "doc", "toc", "pages")


@query("SELECT doc_id, pos, substr(text, pos + 1, 400) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50 - 1, 0) + 1, 350)) AS pos FROM documents WHERE text IS NOT NULL)")
def chunk_windows(spark, folder):
    w = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.explode(C.windows(F.col("text"), 400, 50)).alias("w"))
    return w.select("doc_id", F.col("w.at").cast("long").alias("pos"), "w.piece")


@query(r"SELECT doc_id, count(*) AS headings FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^#{1,6} ')) FROM documents) GROUP BY 1")
def chunk_headings(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.explode(C.by_heading(F.col("text"))).alias("part")).where(F.col("part").rlike("^#{1,6} "))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("headings"))
