"""Queries: retrieval, fusion, metrics."""

from pyspark.sql import functions as F

from lorebase.operators import usage as U
from lorebase.operators import vectors as V
from lorebase.plans.catalogue import query, table
from lorebase.plans.usage import BLOCKS, events

_Q = [0.125 if i % 2 == 0 else -0.125 for i in range(64)]


@query(f"WITH q AS (SELECT {_Q}::DOUBLE[] AS q) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], q) DESC, vec_id LIMIT 25")
def vector_topk(spark, folder):
    return V.nearest(table(spark, folder, "embeddings"), _Q, 25, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE n_chars IS NOT NULL QUALIFY rank <= 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY created_at DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50) SELECT doc_id, sum((1.0::DOUBLE / (60 + rank))::DECIMAL(20,12))::DOUBLE AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def rrf_fusion(spark, folder):
    d = table(spark, folder, "documents")
    a = V.ranked(d.where("n_chars IS NOT NULL"), [F.desc("n_chars"), F.asc("doc_id")], 50)
    b = V.ranked(d, [F.desc("created_at"), F.asc("doc_id")], 50)
    return V.fused([a, b], "doc_id").select("doc_id", F.col("score").cast("double").alias("score"))


@query("WITH r AS (SELECT doc_id, rater, quality FROM labels WHERE quality IS NOT NULL), p AS (SELECT a.quality AS x, b.quality AS y FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.rater < b.rater), t AS (SELECT count(*) AS pairs, count(*) FILTER (x = y) AS eq FROM p), c AS (SELECT sum(l.n * r.n) AS pe FROM (SELECT x AS v, count(*) AS n FROM p GROUP BY 1) l JOIN (SELECT y AS v, count(*) AS n FROM p GROUP BY 1) r USING (v)) SELECT pairs, round(eq / nullif(pairs, 0)::DOUBLE, 9) AS agreement, round((eq / nullif(pairs, 0)::DOUBLE - pe / nullif(pairs * pairs, 0)::DOUBLE) / (1 - pe / nullif(pairs * pairs, 0)::DOUBLE), 9) AS kappa FROM t, c")
def rater_agreement(spark, folder):
    return V.agreement(table(spark, folder, "labels"), "doc_id", "rater", "quality").select("pairs", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query(f"WITH {BLOCKS}, t AS (SELECT session_id, list(name ORDER BY event_id, name) AS a FROM call GROUP BY 1) SELECT session_id, round((CAST(a[1] = 'Read' AS INT) + CAST(coalesce(a[2] = 'Edit', false) AS INT) + CAST(coalesce(a[3] = 'Bash', false) AS INT)) / 3.0::DOUBLE, 6) AS score FROM t")
def trajectory_score(spark, folder):
    calls = U.tool_calls(events(spark, folder))
    actual = calls.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "name"))), lambda x: x["name"]).alias("steps"))
    expected = actual.select("session_id", F.array(F.lit("Read"), F.lit("Edit"), F.lit("Bash")).alias("steps"))
    return V.trajectory(expected, actual, "session_id", "steps").select("session_id", F.round("score", 6).alias("score"))


@query("WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rater) AS rank, coalesce(abusive = 1, false) AS hit FROM labels), q AS (SELECT doc_id, min(CASE WHEN hit THEN rank END) AS rank FROM l GROUP BY 1) SELECT round(avg(coalesce((rank <= 5)::INT::DOUBLE, 0)), 9) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr FROM q")
def retrieval_metrics(spark, folder):
    from pyspark.sql import Window

    l = table(spark, folder, "labels").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("rater")))
    hits = l.groupBy("doc_id").agg(F.min(F.when(F.coalesce(F.col("abusive") == 1, F.lit(False)), F.col("rank"))).alias("rank"))
    return V.retrieval_metrics(hits).select(F.round("hit_rate", 9).alias("hit_rate"), F.round("mrr", 9).alias("mrr"))


@query("WITH m AS (SELECT doc_id, max(coalesce(abusive, 0)) AS m FROM labels GROUP BY 1) SELECT doc_id, rater FROM labels JOIN m USING (doc_id) WHERE coalesce(abusive, 0) = 1 OR m = 0")
def relevant_or_all(spark, folder):
    l = table(spark, folder, "labels").withColumn("hit", F.coalesce(F.col("abusive") == 1, F.lit(False)))
    return V.relevant_or_all(l, "doc_id", "hit").select("doc_id", "rater")
