"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected the same number of copies. The documents of a source are ranked by size, their
expected copies summed along that order from one random offset, and a document is emitted once for each integer its sum
crosses. Ranking by size makes the sample of any source follow its size distribution, so the share in tokens is met,
not only the share in documents. The ranking is range-partitioned: no source is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.tokenizing import count_tokens
from lorebase.operators.ranking import with_position
from lorebase.plans.staging import stage


def source_name(source: Column) -> Column:
    """Sources that differ in case or surrounding blanks are one; blank is null."""
    name = F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))
    return F.when(name != "", name)


def clean_targets(targets: DataFrame) -> DataFrame:
    """``source, weight, max_repeats``, one row per source: weights of different spellings add up, the smallest cap holds.

    Null, negative and NaN weights are 0; a null cap is 1, a negative one 0.
    """
    weight = F.when(F.col("weight") > 0, F.nanvl("weight", F.lit(0.0))).otherwise(0.0)
    cap = F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    return targets.select(source_name(F.col("source")).alias("source"), weight.alias("weight"), cap.alias("max_repeats")).where("source IS NOT NULL").groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))


def sized_documents(documents: DataFrame, targets: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens``, staged: counting is done once. With ``targets`` only the documents of sources that
    can be in a mixture: those with a weight and a cap above 0."""
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    if targets is not None:
        used = clean_targets(targets).where("weight > 0 AND max_repeats > 0").select("source")
        rows = rows.join(F.broadcast(used), "source", "left_semi")  # a row per target source
    return stage(count_tokens(rows, "doc_id", "text", ["source"], path), "sizes")


CORPUS = "corpus"


def plan_mixture(sizes: DataFrame, targets: DataFrame, total: int | str | None = None) -> DataFrame:
    """``source, weight, max_repeats, target_share, aim_share, docs, tokens, longest, goal_tokens, copies``: one row per
    target source.

    ``target_share`` is the weight's share of all weights, ``aim_share`` its share of the weights of the sources that
    have tokens and may be used: what the others can't give is not asked of anyone. ``total``: the tokens of the whole
    mixture; CORPUS takes those of all usable sources. A source that can't reach its share of it is used up to its cap.
    None takes the most for which every usable source reaches its share within its cap, so that the smallest source
    decides how much of all others is used.
    """
    aims = clean_targets(targets)
    have = sizes.where("n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    plan = aims.join(have, "source", "left").fillna(0, ["docs", "tokens", "longest"])
    everything = Window.partitionBy()  # the targets are a table of parameters, a row per source
    usable = (F.col("weight") > 0) & (F.col("tokens") > 0) & (F.col("max_repeats") > 0)
    share = lambda w: F.coalesce(F.try_divide(w, F.sum(w).over(everything)), F.lit(0.0))
    plan = plan.withColumns({"target_share": share(F.col("weight")), "aim_share": share(F.when(usable, F.col("weight")).otherwise(0.0))})
    reach = F.when(F.col("aim_share") > 0, F.col("tokens") * F.col("max_repeats") / F.col("aim_share"))
    corpus = F.sum(F.when(usable, F.col("tokens"))).over(everything).cast("double")
    wanted = corpus if total == CORPUS else F.lit(float(total)) if total is not None else F.min(reach).over(everything)
    plan = plan.withColumn("goal_tokens", F.col("aim_share") * F.coalesce(wanted, F.lit(0.0)))
    copies = F.when(F.col("tokens") > 0, F.least(F.col("goal_tokens") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return plan.withColumn("copies", copies)


def mixture(sizes: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """``doc_id, source, copy, n_tokens``: a row per emitted copy; copies are numbered from 1 up to the source's cap.

    Documents without tokens and of sources without target are not in it. Repeated doc_ids are different documents.
    """
    used = plan.where("copies > 0").select("source", "copies")
    rows = sizes.where("n_tokens > 0").join(F.broadcast(used), "source")  # a row per target source
    rows = with_position(rows.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id")), ["source"], ["n_tokens", "_order", "doc_id"], "_k", "mixture")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    upto = lambda k: F.floor(offset + k * F.col("copies"))
    times = F.least(upto(F.col("_k")) - upto(F.col("_k") - 1), F.ceil("copies"))
    return rows.withColumn("_times", times).where("_times > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("copy"), "n_tokens")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """What was reached, per target source: documents and tokens in the mixture, share, what it lacks of the target
    share (``short_by``), most copies of a document, and ``state``.

    The state goes by the tokens that are in the mixture: ``at its cap`` if that is every document as often as the cap
    allows, ``goal reached`` if they differ from the goal by less than the longest document (what systematic sampling
    can differ by), ``missed`` otherwise; ``no weight`` and ``no documents`` where there is nothing to reach (a source
    without weight, or that may not be used, counts no documents).
    """
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count_distinct("doc_id").alias("mixed_docs"), F.max("copy").alias("most_copies"))
    out = plan.join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_docs", "most_copies"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # a row per target source
    near = F.abs(F.col("mixed_tokens") - F.col("goal_tokens")) < F.greatest("longest", F.lit(1))
    why = F.when((F.col("weight") == 0) | (F.col("max_repeats") == 0), "no weight").when(F.col("tokens") == 0, "no documents")
    why = why.when(F.col("mixed_tokens") == F.col("tokens") * F.col("max_repeats"), "at its cap").when(near, "goal reached").otherwise("missed")
    out = out.withColumn("share", F.coalesce(F.try_divide(F.col("mixed_tokens"), whole), F.lit(0.0)))
    short = F.greatest(F.col("target_share") - F.col("share"), F.lit(0.0))
    return out.select("source", "weight", "max_repeats", "target_share", "aim_share", "docs", "tokens", "goal_tokens", "copies", "mixed_docs", "mixed_tokens", "most_copies", "share", short.alias("short_by"), why.alias("state"))
