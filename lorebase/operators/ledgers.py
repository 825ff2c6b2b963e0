"""Ingestion ledgers: latest entries, change detection, gaps, keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest in ``order`` (nulls lowest); found by partial aggregation. Null keys are a key."""
    rest = [c for c in entries.columns if c not in keys]
    best = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *rest)).alias("_b")
    return entries.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def status(files: DataFrame, ledger: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """``key, status``: new, changed or unchanged against the ledger; a null digest on either side is changed."""
    known = ledger.select(key, F.col(digest).alias("_known"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "new").when(F.coalesce(F.col(digest) != F.col("_known"), F.col(digest).isNotNull() | F.col("_known").isNotNull()), "changed").otherwise("unchanged")
    return files.join(known, key, "left").select(key, state.alias("status"))


def pending(files: DataFrame, ledger: DataFrame, key: str = "path") -> DataFrame:
    """Files the ledger doesn't know."""
    return files.join(ledger.select(key), key, "left_anti")


def by_folder(files: DataFrame, path: Column) -> DataFrame:
    """Files per top folder; those directly in the root are ``root``."""
    parts = F.split(path, "/")
    return files.groupBy(F.when(F.size(parts) > 1, parts[0]).otherwise("root").alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same keys; other old rows stay."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the least in ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *rest)).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def recent_or_latest(rows: DataFrame, day: str, cutoff: str, name: str, limit: int = 20) -> DataFrame:
    """Up to ``limit`` newest rows from the cutoff on; if there are none, the single newest row."""
    ranked = rows.withColumn("_recent", F.col(day) >= cutoff)
    top = ranked.orderBy(F.desc("_recent"), F.desc(name)).limit(limit)
    there = ranked.agg(F.coalesce(F.max("_recent"), F.lit(False)).alias("_any"), F.max(name).alias("_newest"))
    return top.join(F.broadcast(there), F.lit(True)).where(F.when(F.col("_any"), F.col("_recent")).otherwise(F.col(name) == F.col("_newest"))).select(*rows.columns)


def compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, state``: only left, only right or both."""
    l, r = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return l.join(r, key, "full_outer").select(key, F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both").alias("state"))
