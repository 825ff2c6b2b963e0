"""Chunk plans of paged documents and text chunkers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_PAGES = 20
# fixed values: patterns of a table of contents, in order of priority
TOC_PATTERNS = (r"(?im)^(Chapter\s+\d+[:.–-]?\s*.+?)\s+(\d+)\s*$", r"(?m)^(\d+\.\s+[A-Z].+?)\s+(\d+)\s*$", r"(?m)^(\d+\s+[A-Z][a-z].+?)\s+(\d+)\s*$")


def hard_split(docs: DataFrame, key: str, pages: str, most: int = MOST_PAGES) -> DataFrame:
    """``key, start_page, end_page, title``: ranges of at most ``most`` pages, ``Part n``; no pages, no chunks."""
    rows = docs.where(F.col(pages) > 0).select(key, pages, F.posexplode(F.sequence(F.lit(1).cast("bigint"), F.col(pages).cast("bigint"), F.lit(most).cast("bigint"))).alias("i", "start_page"))
    return rows.select(key, "start_page", F.least(F.col("start_page") + most - 1, F.col(pages).cast("bigint")).alias("end_page"), F.format_string("Part %d", F.col("i") + 1).alias("title"))


def section_split(sections: DataFrame, key: str, pages: str, most: int = MOST_PAGES) -> DataFrame:
    """Chunks of ``key, pages, title, page`` sections: each ends before the next begins, the last with the document;
    longer ones are cut with ``(Part n)``. Pages before the first section are in none."""
    end = F.coalesce(F.lead("page").over(Window.partitionBy(key).orderBy("page")) - 1, F.col(pages)).cast("bigint")
    s = sections.withColumn("_end", end).where("_end >= page")
    s = s.select(key, "title", "page", "_end", F.posexplode(F.sequence(F.col("page").cast("bigint"), F.col("_end"), F.lit(most).cast("bigint"))).alias("i", "start_page"))
    title = F.when(F.col("_end") - F.col("page") + 1 <= most, F.col("title")).otherwise(F.format_string("%s (Part %d)", F.col("title"), F.col("i") + 1))
    return s.select(key, "start_page", F.least(F.col("start_page") + most - 1, F.col("_end")).alias("end_page"), title.alias("title"))


def toc_sections(docs: DataFrame, key: str, toc: str, pages: str) -> DataFrame:
    """``key, pages, title, page``: the first title of each page, by pattern and position, within the document's pages."""
    found = None
    for rank, pattern in enumerate(TOC_PATTERNS):
        pairs = F.arrays_zip(F.regexp_extract_all(toc, F.lit(pattern), 1).alias("t"), F.regexp_extract_all(toc, F.lit(pattern), 2).alias("p"))
        part = docs.select(key, F.col(pages).alias("pages"), F.posexplode(pairs).alias("pos", "z")).select(key, "pages", F.lit(rank).alias("rank"), "pos", F.trim(F.col("z.t")).alias("title"), F.col("z.p").cast("int").alias("page"))
        found = part if found is None else found.unionByName(part)
    found = found.where("page BETWEEN 1 AND pages")
    return found.groupBy(key, "pages", "page").agg(F.min(F.struct("rank", "pos", "title"))["title"].alias("title")).select(key, "pages", "title", "page")


def plan(docs: DataFrame, key: str, toc: str, pages: str, most: int = MOST_PAGES) -> DataFrame:
    """One chunk for short documents, sections where the contents can be read, else equal ranges."""
    short = docs.where(F.col(pages).between(1, most)).select(key, F.lit(1).cast("bigint").alias("start_page"), F.col(pages).cast("bigint").alias("end_page"), F.lit("Full Document").alias("title"))
    long = docs.where(F.col(pages) > most)
    sections = toc_sections(long, key, toc, pages)
    rest = long.join(sections.select(key).distinct(), key, "left_anti")
    return short.unionByName(section_split(sections, key, "pages", most)).unionByName(hard_split(rest, key, pages, most))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed pieces of ``size`` characters that overlap, as (position, piece) structs."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("at"), F.substring(text, s + 1, F.lit(size)).alias("piece")))


def by_heading(text: Column) -> Column:
    """Parts of a Markdown text that begin with a heading (the first may not)."""
    return F.filter(F.split(text, r"(?m)(?=^#{1,6} )"), lambda p: F.trim(p) != "")


def key_sentences(text: Column, low: int = 30, high: int = 400) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s).between(low, high))


def fold_chunks(chunks: DataFrame, key: str, order: str, text: str, step) -> DataFrame:
    """Sequential map with carry per document: ``step(previous, text) -> note``; the model is passed in.

    A document's chunks are folded in one task (they depend on each other); ``key, notes``.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        carry, notes = "", []
        for t in pdf.sort_values(order)[text]:
            carry = step(carry, t)
            notes.append(carry)
        return pd.DataFrame({key: pdf[key].iloc[:1], "notes": [notes]})

    kind = dict(chunks.dtypes)[key]
    return chunks.groupBy(key).applyInPandas(run, f"{key} {kind}, notes array<string>")
