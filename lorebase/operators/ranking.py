"""Numbering rows inside groups of any size without gathering a group in one task.

The rows are range-partitioned by (group, order), so a group that holds a third of all rows spreads over a third of the
partitions. ``monotonically_increasing_id`` after the local sort is then an increasing global mark; the position inside
the group is the mark's distance from the fragment's first mark plus the rows of the group's earlier fragments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.plans.staging import shuffle_width, stage

MARK, FRAGMENT = "_mark", "_fragment"


def ordered_fragments(df: DataFrame, group: list[str], order: list[str], label: str = "ordered") -> DataFrame:
    """``df`` with ``_fragment`` (range partition) and ``_mark`` (increasing along group, order), written once."""
    width = shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(width, *group, *order).sortWithinPartitions(*group, *order)
    return stage(ranged.withColumn(MARK, F.monotonically_increasing_id()).withColumn(FRAGMENT, F.shiftright(MARK, 33).cast("int")), label)


def with_position(df: DataFrame, group: list[str], order: list[str], position: str = "pos", label: str = "ranked") -> DataFrame:
    """``df`` with the 1-based position of each row within its group in the given order.

    Nulls in ``group`` form one group; ties are numbered in an arbitrary but stable order (add a unique column to
    ``order`` for a defined one). An empty input gives an empty output with the same columns.
    """
    rows = ordered_fragments(df, group, order, label)
    parts = rows.groupBy(*group, FRAGMENT).agg(F.count(F.lit(1)).alias("_n"), F.min(MARK).alias("_first"))
    before = Window.partitionBy(*group).orderBy(FRAGMENT).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    a, b = rows.alias("a"), parts.alias("b")
    on = F.col(f"a.{FRAGMENT}") == F.col(f"b.{FRAGMENT}")
    for g in group:
        on = on & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    place = F.col(f"a.{MARK}") - F.col("b._first") + F.col("b._before") + 1
    return a.join(b, on).select(*[F.col(f"a.{c}") for c in df.columns], place.alias(position))


def silences(rows: DataFrame, group: list[str], at: str) -> DataFrame:
    """``group..., gap``: the differences of ``at`` between neighbouring rows of ordered fragments, also across their borders."""
    inside = Window.partitionBy(*group, FRAGMENT).orderBy(MARK)
    within = rows.select(*group, (F.col(at) - F.lag(at).over(inside)).alias("gap"))
    ends = rows.groupBy(*group, FRAGMENT).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    along = Window.partitionBy(*group).orderBy(FRAGMENT)  # a row per range partition that the group reaches
    across = ends.select(*group, (F.col("_a") - F.lag("_b").over(along)).alias("gap"))
    return within.unionByName(across).where("gap IS NOT NULL")


def segments(rows: DataFrame, group: list[str], at: str, gap: int, segment: str = "segment") -> DataFrame:
    """Ordered fragments with the number, from 0, of the part of their group they belong to: a part ends where ``at``
    rises by more than ``gap``. No group is gathered; what crosses a border is settled on a row per group and partition.
    """
    far = lambda later, earlier: F.coalesce((later - earlier > gap).cast("int"), F.lit(0))
    inside = Window.partitionBy(*group, FRAGMENT).orderBy(MARK)
    rows = rows.withColumn("_cut", far(F.col(at), F.lag(at).over(inside)))
    rows = rows.withColumn("_part", F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*group).orderBy(FRAGMENT)
    ends = rows.groupBy(*group, FRAGMENT).agg(F.min(at).alias("_a"), F.max(at).alias("_b"), F.sum("_cut").alias("_cuts"))
    ends = ends.withColumn("_new", far(F.col("_a"), F.lag("_b").over(along)) + F.coalesce(F.lag("_cuts").over(along), F.lit(0)))
    base = ends.select(*group, FRAGMENT, F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_base"))
    return rows.join(base, [*group, FRAGMENT]).withColumn(segment, F.col("_base") + F.col("_part")).drop("_cut", "_part", "_base")
