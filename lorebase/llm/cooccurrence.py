"""Items that appear together: pair counts, lift and pointwise mutual information over baskets.

An item below the support threshold cannot be in a reported pair, so baskets are first cut to frequent items. There are
at most (mean basket length / least share) frequent items whatever the number of baskets; their table is joined, the
pairs of a basket are emitted in order once, and counts are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import canonical_tag, current_pages, page_tags
from lorebase.plans.staging import stage


def tag_records(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, key, items: one row per page path (current row) and per node id (items of all its rows), empty ones too."""
    page = current_pages(pages, "tags").select(F.lit("pages").alias("src"), F.col("path").alias("key"), page_tags(F.col("tags")).alias("items"))
    tags = F.coalesce(F.col("data.tags"), F.array().cast("array<string>"))
    node = nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.flatten(F.collect_set(tags)).alias("items"))
    node = node.select(F.lit("nodes").alias("src"), F.col("id").alias("key"), "items")
    return page.unionByName(node)


def cleaned(items: Column) -> Column:
    """Canonical, distinct, sorted, without blanks and nulls."""
    tags = F.transform(F.filter(items, lambda t: t.isNotNull()), canonical_tag)
    return F.array_sort(F.array_distinct(F.filter(tags, lambda t: t != "")))


def together(records: DataFrame, least_count: int = 3, least_share: float = 0.002, least_lift: float = 3.0) -> DataFrame:
    """``src, item_a, item_b, n_a, n_b, n_ab, n, lift, pmi`` of the pairs that pass all three thresholds.

    ``records``: src, key, items, one row per record. A record counts in ``n`` also without items; an item counts once
    per record; ``item_a < item_b`` in byte order. Null items and blanks are no item. No records, no rows.
    """
    base = stage(records.select("src", cleaned(F.col("items")).alias("items")), "baskets")
    totals = base.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    singles = base.select("src", F.explode("items").alias("item")).groupBy("src", "item").agg(F.count(F.lit(1)).alias("n_item"))
    share = F.lit(str(least_share)).cast("decimal(12,8)")
    enough = (F.col("n_item") >= least_count) & (F.col("n_item") >= share * F.col("n"))
    frequent = singles.join(F.broadcast(totals), "src").where(enough)  # a row per source
    # sizes are bounded by the thresholds, not by the corpus: one row per source, each with its frequent items
    kept = frequent.groupBy("src").agg(F.collect_list("item").alias("_frequent"))
    slim = base.join(F.broadcast(kept), "src").select("src", F.array_intersect("items", "_frequent").alias("items")).where(F.size("items") > 1)
    # an item at a time with those behind it: never more than a basket's items in a row
    each = slim.select("src", "items", F.posexplode("items").alias("i", "item_a"))
    behind = each.select("src", "item_a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item_b"))
    pairs = behind.groupBy("src", "item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab"))
    a = frequent.select("src", F.col("item").alias("item_a"), F.col("n_item").alias("n_a"), "n")
    b = frequent.select("src", F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    found = pairs.where((F.col("n_ab") >= least_count)).join(a, ["src", "item_a"]).join(b, ["src", "item_b"])
    product = F.col("n_a").cast("decimal(20,0)") * F.col("n_b")
    found = found.where((F.col("n_ab") >= share * F.col("n")) & (F.col("n_ab").cast("decimal(20,0)") * F.col("n") >= product * F.lit(str(least_lift)).cast("decimal(10,4)")))
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return found.select("src", "item_a", "item_b", "n_a", "n_b", "n_ab", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))
