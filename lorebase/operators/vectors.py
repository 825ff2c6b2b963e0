"""Retrieval: vector and keyword rankings, fusion, gates, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.graph import dot


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """The ``k`` rows of greatest cosine to a query vector (unit vectors), ties by key; null vectors are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(vector).isNotNull()).select(key, dot(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def fused(rankings: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of tables ``key, rank``: ``key, score``."""
    rows = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(key, "rank"))
    return rows.groupBy(key).agg(F.sum((F.lit(1) / (F.lit(k) + F.col("rank"))).cast("decimal(20,12)")).alias("score"))


def ranked(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their rank; the window runs over those rows only."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid(term: Column, cosine: Column) -> Column:
    return 0.3 * term + 0.7 * cosine


def gate(confidence: Column, least: float = 0.3) -> Column:
    """``answer`` or ``retry``."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) >= least, "answer").otherwise("retry")


def relevant_or_all(rows: DataFrame, query: str, flag: str) -> DataFrame:
    """The rows flagged relevant; of queries without any, all rows."""
    any_ = rows.groupBy(query).agg(F.max(F.col(flag)).alias("_any"))
    return rows.join(any_, query).where(F.col(flag) | ~F.coalesce("_any", F.lit(False))).drop("_any")


def retrieval_metrics(hits: DataFrame, k: int = 5) -> DataFrame:
    """One row: hit rate at ``k`` and mean reciprocal rank of ``query, rank`` (rank null: not found)."""
    return hits.agg(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def agreement(ratings: DataFrame, item: str, rater: str, value: str) -> DataFrame:
    """One row: share of equal pairs of ratings of the same item by different raters, their number, and Cohen's kappa.

    Kappa takes the marginals of both sides of the pairs. Null ratings are left out.
    """
    r = ratings.where(F.col(value).isNotNull()).select(F.col(item).alias("i"), F.col(rater).alias("r"), F.col(value).alias("v"))
    pairs = r.alias("a").join(r.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.r") < F.col("b.r"))).select(F.col("a.v").alias("x"), F.col("b.v").alias("y"))
    cells = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    left, right = cells.groupBy(F.col("x").alias("v")).agg(F.sum("n").alias("l")), cells.groupBy(F.col("y").alias("v")).agg(F.sum("n").alias("r"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("both"))
    seen = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)), F.lit(0)).alias("equal"))
    out = seen.join(F.broadcast(chance), F.lit(True))
    po, pe = F.try_divide("equal", "pairs"), F.try_divide("both", F.col("pairs") * F.col("pairs"))
    return out.select("pairs", po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def trajectory(expected: DataFrame, actual: DataFrame, key: str, steps: str) -> DataFrame:
    """Share of expected steps that stand at the same position in the actual list."""
    both = expected.select(key, F.col(steps).alias("e")).join(actual.select(key, F.col(steps).alias("a")), key, "left")
    same = F.size(F.filter(F.arrays_zip("e", F.coalesce("a", F.array().cast("array<string>")).alias("a")), lambda z: z["e"] == z["a"]))
    return both.select(key, F.coalesce(F.try_divide(same, F.size("e")), F.lit(0.0)).alias("score"))


def best_per(rows: DataFrame, fingerprint: Column, score: str, key: str) -> DataFrame:
    """``key, copies``: of the rows with a fingerprint the one of the highest score, ties to the least key; nulls score lowest."""
    best = F.max(F.struct(F.coalesce(F.col(score), F.lit(-1)).alias("s"), (-F.col(key)).alias("k"))).alias("b")
    return rows.groupBy(fingerprint.alias("_f")).agg(best, F.count(F.lit(1)).alias("copies")).select((-F.col("b.k")).alias(key), "copies")
