"""Streams: a watched folder whose graph is computed anew, and windowed counts of live events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorebase.functions import frontmatter as M
from lorebase.operators import graph as G
from lorebase.operators.search import parent_folder, stem
from lorebase.sources.files import markdown


def graph_of(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a Markdown tree."""
    texts = markdown(spark, root)
    c = F.col("text")
    pages = texts.select("path", M.index_fields(c)["title"].alias("title"), F.array_join(M.index_tags(c), " ").alias("tags"), M.index_fields(c)["summary"].alias("summary"), M.index_fields(c)["updated"].alias("updated"), c.alias("content"))
    nodes = G.build_nodes(pages)
    links = G.link_edges(pages.select(stem(F.col("path")).alias("id"), "content"), nodes.select("id"))
    tags = G.tag_edges(nodes).withColumn("edge_type", F.lit("tag-shared"))
    return nodes, G.all_edges(links, tags)


def fingerprint(spark: SparkSession, root: str) -> str:
    """Changes with any file's path or text: order-free sums over hashes, so edits and deletions count too."""
    row = markdown(spark, root).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "text").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


def watch(spark: SparkSession, root: str, checkpoint: str, publish: Callable[[DataFrame, DataFrame], None], trigger: dict | None = None) -> StreamingQuery:
    """Recompute and publish the whole graph when the folder's fingerprint changes.

    A file source never returns a file it has seen, so edits of a path would be lost; a rate source ticks instead, and
    each tick compares fingerprints. The last fingerprint is kept in the checkpoint folder and survives a restart.
    """
    mark = f"{checkpoint.rstrip('/')}/fingerprint"

    def tick(_: DataFrame, __: int) -> None:
        now = fingerprint(spark, root)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mark)
        there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        last = spark.read.text(mark).first() if there else None  # a mark that can't be read is an error, not a change
        if last is None or now != last[0]:
            publish(*graph_of(spark, root))
            spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(mark)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", f"{checkpoint}/stream").trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def new_files(spark: SparkSession, root: str, schema: str, per_batch: int = 100) -> DataFrame:
    """A scheduled micro-batch over new JSON files, at most so many at a time; run with ``availableNow``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(root)


def event_counts(events: DataFrame, at: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and type, with a watermark for late events."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def live_sessions(events: DataFrame, by: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions that end after a silence of ``gap``."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
