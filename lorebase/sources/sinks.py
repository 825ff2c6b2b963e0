"""Sinks: idempotent text files, keyed upserts of Parquet tables, ledgers, reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.frontmatter import index_fields
from lorebase.functions.hashing import url_hash
from lorebase.operators.ledgers import merged
from lorebase.sources.files import list_files


def write_texts(rows: DataFrame, folder: str, name: str = "name", text: str = "markdown", keep: bool = True) -> DataFrame:
    """One file per row, written by tasks to a shared or local folder; with ``keep`` existing files stay as they are.

    Names may have folders, which are made; one that leads out of the folder is refused. Written aside and renamed, so a
    task that is tried again leaves whole files. Returns ``name, state``.
    """
    os.makedirs(folder, exist_ok=True)
    root = os.path.realpath(folder)

    def run(batches):
        import pandas as pd

        for b in batches:
            states = []
            for n, t in zip(b["name"], b["text"]):
                path = os.path.realpath(os.path.join(root, n))
                if not path.startswith(root + os.sep):
                    states.append("refused")
                    continue
                if keep and os.path.exists(path):
                    states.append("kept")
                    continue
                os.makedirs(os.path.dirname(path), exist_ok=True)
                aside = f"{path}.{os.getpid()}.part"
                with open(aside, "w", encoding="utf-8") as f:
                    f.write(t or "")
                os.replace(aside, path)
                states.append("written")
            yield pd.DataFrame({"name": b["name"].tolist(), "state": states}, dtype=object)

    return rows.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.col(text).alias("text")).mapInPandas(run, "name string, state string")


def captured(rows: DataFrame, captures: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose address no capture has: captures (``text``) name the hash of theirs as ``url_hash`` in their front matter."""
    known = captures.select(index_fields(F.col("text"))["url_hash"].alias("_h")).where("_h IS NOT NULL").distinct()
    return rows.join(known, url_hash(F.col(url)) == F.col("_h"), "left_anti")


def missing(rows: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Rows whose file isn't there yet."""
    spark = rows.sparkSession
    there = list_files(spark, folder, "").select(F.substring_index("path", "/", -1).alias(name))
    return rows.join(there, name, "left_anti")


def upsert(new: DataFrame, path: str, keys: list[str]) -> None:
    """Keyed merge into a Parquet table: the merged table is written aside, then takes the old one's place.

    The old table is put aside before and deleted after that; a run that was cut off between is mended by the next
    (``settled``), so there is always one whole table.
    """
    spark = new.sparkSession
    jvm = spark.sparkContext._jvm
    at = lambda end: jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end)
    fs = settled(spark, path)
    out = merged(spark.read.parquet(path), new, keys) if fs.exists(at("")) else new
    fs.delete(at(".new"), True)
    out.write.parquet(str(at(".new")))
    if fs.exists(at("")):
        fs.rename(at(""), at(".old"))
    fs.rename(at(".new"), at(""))
    fs.delete(at(".old"), True)


def settled(spark: SparkSession, path: str):
    """The file system of a table, after an upsert that was cut off has been mended."""
    jvm = spark.sparkContext._jvm
    target, old = jvm.org.apache.hadoop.fs.Path(path.rstrip("/")), jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".old")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            fs.rename(old, target)
    return fs


def append_index(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def by_topic(rows: DataFrame, path: str, topic: str = "topic") -> None:
    rows.write.mode("append").partitionBy(topic).parquet(path)


def write_report(spark: SparkSession, folder: str, day: str, time: str, text: str, facts: dict) -> None:
    """A dated report to which runs are appended, and ``latest.json``."""
    import json

    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{day}.md"), "a", encoding="utf-8") as f:
        f.write(f"\n# Run {time}\n\n{text}\n")
    with open(os.path.join(folder, "latest.json"), "w", encoding="utf-8") as f:
        json.dump(facts | {"date": day, "time": time}, f)
