"""Reading tables and the notions several operators share: current page rows, page dates, canonical tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_day(updated: Column) -> Column:
    """``updated`` as a sortable yyyymmdd number; ``2026-1-5`` and ``2026/01/05`` are read too, anything else is 0."""
    part = lambda i: F.regexp_extract(updated, r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", i).try_cast("int")
    return F.coalesce(part(1) * 10000 + part(2) * 100 + part(3), F.lit(0))


def current_pages(pages: DataFrame, *columns: str) -> DataFrame:
    """One row per path: the row of the latest ``updated``; ties go to the greatest remaining values, nulls lowest.

    Rows without a path are no page and are left out. The maximum is found by partial aggregation, so a path that is
    delivered very often does not gather its texts in one task.
    """
    rest = [c for c in columns if c != "path"]
    best = F.max(F.struct(page_day(F.col("updated")).alias("_day"), F.coalesce(F.col("updated"), F.lit("")).alias("_raw"), *[F.col(c) for c in rest]))
    return pages.where(F.col("path").isNotNull()).groupBy("path").agg(best.alias("_best")).select("path", *[F.col(f"_best.{c}").alias(c) for c in rest])


def canonical_tag(tag: Column) -> Column:
    """Lower case, ``-`` for ``_``, without leading ``#`` and surrounding blanks or commas."""
    bare = F.regexp_replace(F.lower(tag), r"^[\s,]+|[\s,]+$", "")
    return F.translate(F.regexp_replace(F.regexp_replace(bare, r"^#+", ""), r"^[\s,]+|[\s,]+$", ""), "_", "-")


def page_tags(tags: Column) -> Column:
    """The tags of a page's tag string, whose separators are blanks and commas."""
    return F.split(F.coalesce(tags, F.lit("")), r"[\s,;]+")
