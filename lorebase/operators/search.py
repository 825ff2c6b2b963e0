"""Search, lookup, listing and briefing over a page table ``path, title, tags, summary, updated, content``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions import text as X

# fixed values: type tags, their order in a briefing, domain tags
TYPE_TAGS = ("concept", "pattern", "decision", "project", "comparison", "reference", "conflict")
BRIEFING_ORDER = {"decision": 0, "pattern": 1, "comparison": 2, "concept": 3, "reference": 4, "project": 5}
DOMAIN_TAGS = ("langgraph", "rag", "adk", "mcp", "memory", "eval", "infra", "deep-agents", "patterns", "meta", "projects")


def tag_list(tags: Column) -> Column:
    return F.filter(F.split(F.coalesce(tags, F.lit("")), r"[\s,]+"), lambda t: t != "")


def first_type(tags: Column, types: tuple[str, ...] = TYPE_TAGS, default: str = "concept") -> Column:
    """The first tag that is a type tag."""
    return F.coalesce(F.try_element_at(F.filter(tags, lambda t: t.isin(*types)), F.lit(1)), F.lit(default))


def parent_folder(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def path_order(path: Column) -> Column:
    """Paths sort component by component, not as strings."""
    return F.split(path, "/")


def in_scope(pages: DataFrame, scope: str) -> DataFrame:
    """Rows below the folder of that name (``_`` is ``-``, any case) if it exists, else rows whose tags hold the scope.

    Whether it exists is one row for the whole table, joined by broadcast; no rows are collected.
    """
    folder = scope.lower().replace("_", "-")
    inside = F.array_contains(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), folder)
    known = pages.agg(F.coalesce(F.max(inside), F.lit(False)).alias("_known"))
    return pages.join(F.broadcast(known), F.lit(True)).where(F.when(F.col("_known"), inside).otherwise(X.holds(F.col("tags"), scope))).drop("_known")


def search(pages: DataFrame, text: str, scope: str | None = None, limit: int = 10, wildcards: bool = False) -> DataFrame:
    """Rows whose content, title or summary hold the text: title hits first, then the latest ``updated`` (as text), then path.

    ``wildcards``: ``%`` and ``_`` in the text match as in LIKE. Nulls hold nothing; a null ``updated`` comes last.
    """
    rows = in_scope(pages, scope) if scope else pages
    hit = X.like if wildcards else X.holds
    rows = rows.where(hit(F.col("content"), text) | hit(F.col("title"), text) | hit(F.col("summary"), text))
    top = rows.orderBy(F.when(hit(F.col("title"), text), 0).otherwise(1), F.desc_nulls_last("updated"), "path").limit(limit)
    return top.select("path", "title", "tags", "summary", X.snippet(F.coalesce("content", F.lit("")), text).alias("snippet"))


def term_search(pages: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Rows with the greatest weighted term score; ties by path."""
    rows = pages.withColumn("score", X.term_score(text, F.col("title"), F.col("summary"), F.col("content"))).where("score > 0")
    return rows.orderBy(F.desc("score"), "path").limit(limit).select("path", "title", "summary", "score", X.excerpt(F.coalesce("content", F.lit(""))).alias("excerpt"))


def read_page(pages: DataFrame, wanted: str) -> DataFrame:
    """The page of a path, else of a path below ``wiki/``, else the first whose name holds the slug of the text, else up
    to ten whose name holds its first word: the first of these that gives rows (``rank`` says which)."""
    slug = X.slug_dashes(F.lit(wanted))
    words = [w for w in wanted.lower().split() if w]
    name = F.lower(stem(F.col("path")))
    rank = F.when(F.col("path") == wanted, 1).when(F.col("path") == f"wiki/{wanted}", 2).when((slug != "") & F.contains(name, slug), 3)
    if words:
        rank = rank.when(F.contains(name, F.lit(words[0])), 4)
    found = pages.withColumn("rank", rank).where("rank IS NOT NULL")
    best = found.agg(F.min("rank").alias("_best"))
    rows = found.join(F.broadcast(best), F.col("rank") == F.col("_best")).drop("_best")
    return rows.orderBy(path_order(F.col("path"))).limit(10).select("rank", "path", "title", "content")


def list_pages(pages: DataFrame, tag: str | None = None, folder: str | None = None) -> DataFrame:
    """``path, title, tags, summary`` in path order; no tags are ``none``."""
    tags = tag_list(F.col("tags"))
    rows = pages
    if tag:
        rows = rows.where(F.array_contains(tags, tag))
    if folder:
        rows = rows.where(parent_folder(F.col("path")) == folder.lower().replace("_", "-"))
    shown = F.when(F.size(tags) == 0, "none").otherwise(F.array_join(tags, ", "))
    return rows.orderBy(path_order(F.col("path"))).select("path", F.coalesce("title", stem(F.col("path"))).alias("title"), shown.alias("tags"), F.coalesce("summary", F.lit("")).alias("summary"))


def briefing(pages: DataFrame, by: Column) -> DataFrame:
    """One text per group: its pages by type rank and title."""
    kind = first_type(tag_list(F.col("tags")))
    rank = F.create_map(*[F.lit(x) for kv in BRIEFING_ORDER.items() for x in kv])
    line = F.struct(F.coalesce(rank[kind], F.lit(9)).alias("r"), F.coalesce("title", stem(F.col("path"))).alias("t"), F.col("path").alias("p"), F.concat_ws(": ", "title", "summary").alias("line"))
    rows = pages.select(by.alias("domain"), line.alias("l")).groupBy("domain").agg(F.array_sort(F.collect_list("l")).alias("ls"), F.count(F.lit(1)).alias("pages"))
    return rows.select("domain", "pages", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("briefing"))


def page_by_id(pages: DataFrame, page_id: str) -> DataFrame:
    """``rank, path, text``: the page of that file name (rank 1), else the first in path order whose title is the id with
    blanks for its hyphens (rank 2; files that begin with ``_`` aside), as a text with title and summary. No page, no row.
    """
    title = F.coalesce("title", stem(F.col("path")))
    named = F.lower(title) == page_id.lower().replace("-", " ")
    rank = F.when(stem(F.col("path")) == page_id, 1).when(named & ~F.substring_index("path", "/", -1).startswith("_"), 2)
    text = F.concat(F.lit("# "), title, F.lit("\n\nSummary: "), F.coalesce("summary", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    return pages.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", path_order(F.col("path"))).limit(1).select("rank", "path", text.alias("text"))


def dashboard_search(pages: DataFrame, text: str) -> DataFrame:
    """Pages whose title holds the text in any case, or whose tags, joined by blanks, hold it in lower case."""
    tags = F.array_join(tag_list(F.col("tags")), " ")
    hit = X.holds(F.coalesce("title", stem(F.col("path"))), text) | F.contains(tags, F.lit(text.lower()))
    return pages.where(hit).select("path", F.coalesce("title", stem(F.col("path"))).alias("title"), tags.alias("tags")).orderBy("title", "path")


def selected(pages: DataFrame, tags: tuple[str, ...] = (), types: tuple[str, ...] = ()) -> DataFrame:
    """Pages with one of the tags and of one of the types; an empty choice lets everything pass."""
    own = tag_list(F.col("tags"))
    rows = pages.where(F.arrays_overlap(own, F.array(*map(F.lit, tags)))) if tags else pages
    return rows.where(first_type(own).isin(*types)) if types else rows


def index_of(pages: DataFrame) -> DataFrame:
    """``id, path, title, tags, summary, updated`` for an index, with defaults for what is null."""
    return pages.select(stem(F.col("path")).alias("id"), "path", F.coalesce("title", stem(F.col("path"))).alias("title"), F.array_join(tag_list(F.col("tags")), " ").alias("tags"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("updated", F.lit("")).alias("updated"))
