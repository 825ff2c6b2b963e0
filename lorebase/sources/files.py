"""File sources: Markdown trees, JSONL and JSON ledgers, bookmark lists, binary files.

Spark leaves out names that begin with ``_`` or ``.``. Where underscore files count, the paths are listed through the
Hadoop file system (names only) and read by tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "path string, hash string, ingested_at string, wiki_pages array<string>"


def relative(path: Column, root: str) -> Column:
    """The path below ``root`` (decoded), the whole path if it lies elsewhere."""
    plain = F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    base = root.rstrip("/").removeprefix("file://") + "/"
    return F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 2**30)).otherwise(plain)


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of all ``*.md`` files below root, without names that begin with ``_`` or ``.``; undecodable bytes are dropped."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return df.select(relative(F.col("_metadata.file_path"), root).alias("path"), F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("text"))


def list_files(spark: SparkSession, root: str, suffix: str, hidden: bool = True) -> DataFrame:
    """``path`` of files below root by their names; ``hidden``: names with ``_`` too (those with ``.`` never)."""
    jvm = spark.sparkContext._jvm
    start = jvm.org.apache.hadoop.fs.Path(root)
    fs = start.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, it = [], fs.listFiles(start, True)
    while it.hasNext():
        p = it.next().getPath()
        name = p.getName()
        if name.endswith(suffix) and not name.startswith(".") and (hidden or not name.startswith("_")):
            found.append((p.toString(),))
    return spark.createDataFrame(found, "path string")


def markdown_with_hidden(spark: SparkSession, root: str) -> DataFrame:
    """As ``markdown``, with ``_index.md`` and the like; files are opened by tasks from local or mounted paths."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = [p.removeprefix("file:") for p in b["path"]]
            yield pd.DataFrame({"path": b["path"].tolist(), "text": [open(p, encoding="utf-8", errors="ignore").read() for p in paths]}, dtype=object)

    files = list_files(spark, root, ".md").repartition(max(1, spark.sparkContext.defaultParallelism))
    return files.mapInPandas(read, "path string, text string").select(relative(F.col("path"), root).alias("path"), "text")


def json_ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSONL ledger, blank and bad lines left out; of equal paths the last line counts."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", LEDGER).alias("e"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    best = F.max(F.struct("at", "e")).alias("b")
    return lines.where("e.path IS NOT NULL").groupBy("e.path").agg(best).select("b.e.*")


def object_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``key, date, hash, note`` of one JSON object ``{key: {...}}``; an unreadable file has no rows."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.explode(F.from_json("value", "map<string, struct<date:string,hash:string,note:string>>")).alias("key", "v")).select("key", "v.*")


def existing(spark: SparkSession, roots: list[str]) -> list[str]:
    """The roots that exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return [r for r in roots if (p := jvm.org.apache.hadoop.fs.Path(r)).getFileSystem(conf).exists(p)]


def session_lines(spark: SparkSession, roots: list[str], depth: int | None = None) -> DataFrame:
    """``session_id, line_no, value`` of JSONL files below the roots, without sub-agents' files and lines that aren't JSON.

    ``line_no`` increases within a file; the value is a VARIANT. Roots that are missing are skipped; ``depth``: only
    files in folders so many levels below their root.
    """
    there = existing(spark, roots)
    if not there:
        return spark.createDataFrame([], "session_id string, line_no long, value string").select("session_id", "line_no", F.try_parse_json("value").alias("value"))
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(there)
    if depth is not None:
        shortest = F.array_min(F.array(*[F.size(F.split(relative(F.col("_metadata.file_path"), root), "/")) for root in there]))
        df = df.where(shortest == depth + 1)
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), F.try_parse_json("value").alias("value"))
    rows = rows.where(F.col("value").isNotNull() & ~F.contains("file", F.lit("/subagents/")))
    return rows.select(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("session_id"), "line_no", "value")


def session_events(lines: DataFrame) -> DataFrame:
    """Columns of session lines: ``session_id, line_no, type, role, timestamp, cwd, model, content, usage``."""
    get = lambda path, kind="string": F.try_variant_get("value", path, kind)
    usage = F.struct(*[F.coalesce(get(f"$.message.usage.{k}", "bigint"), F.lit(0)).alias(k) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")])
    content = F.coalesce(get("$.message.content"), get("$.content"))
    return lines.select("session_id", "line_no", get("$.type").alias("type"), F.coalesce(get("$.message.role"), get("$.role")).alias("role"), get("$.timestamp").alias("timestamp"), get("$.cwd").alias("cwd"), get("$.message.model").alias("model"), content.alias("content"), usage.alias("usage"))


def first_line_meta(lines: DataFrame, first: int = 5) -> DataFrame:
    """``session_id, branch, repo, date`` from the first lines of a session; later ones overwrite earlier."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("line_no")
    get = lambda path: F.try_variant_get("value", path, "string")
    head = lines.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= first) & get("$.git.branch").isNotNull())
    repo = F.replace(F.substring_index(F.coalesce(get("$.git.repository_url"), F.lit("")), "/", -1), F.lit(".git"), F.lit(""))
    return head.groupBy("session_id").agg(F.max_by(F.struct(get("$.git.branch").alias("branch"), repo.alias("repo"), F.substring(get("$.timestamp"), 1, 10).alias("date")), "_n").alias("m")).select("session_id", "m.*")


def keyed_json(spark: SparkSession, root: str, schema: T.StructType | str, key: str = "session_id") -> DataFrame:
    """One JSON object per file; the key is the field or else the file's name; unreadable files are left out."""
    df = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(root)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    if key not in df.columns:
        return df.select("*", stem.alias(key))
    return df.select("*", F.coalesce(F.col(key), stem).alias("_key")).drop(key).withColumnRenamed("_key", key)


def bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """``url`` lines of a list; lines that don't begin with http are comments."""
    return spark.read.text(path).where(F.col("value").startswith("http")).select(F.trim("value").alias("url"))


def binaries(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, length, head_hash`` of binary files; only the head is hashed."""
    from lorebase.functions.hashing import head_hash

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return df.select(relative(F.col("path"), root).alias("path"), "length", head_hash(F.col("content")).alias("head_hash"))


def pdf_pages(spark: SparkSession, root: str) -> DataFrame:
    """``path, page, text`` by a PDF library where one is installed; blank pages are left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    rows += [(path, i + 1, t) for i, p in enumerate(pdf.pages) if (t := p.extract_text() or "").strip()]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return df.mapInPandas(run, "path string, page int, text string")


def page_counts(pages: DataFrame) -> DataFrame:
    """``path, pages`` of ``pdf_pages``: the number of the last page with text."""
    return pages.groupBy("path").agg(F.max("page").alias("pages"))


def page_range(pages: DataFrame, first: int = 1, last: int = 10) -> DataFrame:
    """``path, text``: the pages ``first`` to ``last``, both included, joined by form feeds; by default those that can
    hold a table of contents. A path without text there has no row."""
    some = pages.where(F.col("page").between(first, last)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return some.select("path", F.array_join(F.transform("p", lambda x: x["text"]), "\f").alias("text"))


def code_tree(root: str, entries: int = 30, lines: int = 100) -> str:
    """A folder for a prompt: its first entries by name, folders first, and the first lines of its README."""
    from pathlib import Path

    top = Path(root)
    found = sorted(top.iterdir(), key=lambda p: (not p.is_dir(), p.name))[:entries]
    out = [f"{top.name}/", *(f"{'  ' if p.is_file() else '  [dir] '}{p.name}" for p in found)]
    readme = next((p for end in (".md", ".rst", ".txt", "") if (p := top / f"README{end}").is_file()), None)
    if readme:
        with readme.open(encoding="utf-8", errors="replace") as f:
            out += ["", "--- README ---", *(line.rstrip("\n") for _, line in zip(range(lines), f))]
    return "\n".join(out)


def tail(lines: DataFrame, order: str, n: int = 200) -> DataFrame:
    return lines.orderBy(F.desc(order)).limit(n)


def harvest(spark: SparkSession, root: str, folders: tuple[str, ...], skip: tuple[str, ...] = ()) -> DataFrame:
    """Markdown files that lie in one of the named folders and in none of the projects to skip."""
    parts = F.split("path", "/")
    inside = F.arrays_overlap(parts, F.array(*[F.lit(f) for f in folders]))
    return markdown(spark, root).where(inside & ~(F.arrays_overlap(parts, F.array(*[F.lit(s) for s in skip])) if skip else F.lit(False)))
