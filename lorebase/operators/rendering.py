"""Records to Markdown and Markdown to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions import frontmatter as M
from lorebase.functions.text import strip


def issue_markdown(issue: DataFrame) -> DataFrame:
    """``id, markdown`` of issue rows; missing parts have defaults, comments follow in order."""
    names = F.array_join(F.transform(F.filter("labels.nodes", lambda n: n["name"].isNotNull()), lambda n: n["name"]), ", ")
    line = lambda label, value: F.concat(F.lit(f"**{label}:** "), value, F.lit("  "))
    quote = lambda c: F.concat(F.lit("> **"), F.coalesce(c["user"]["name"], F.lit("Unknown")), F.lit("** ("), F.coalesce(F.date_format(c["created_at"], "yyyy-MM-dd"), F.lit("")), F.lit("): "), F.coalesce(c["body"], F.lit("")))
    comments = F.coalesce("comments.nodes", F.array().cast("array<struct<body:string,created_at:timestamp,user:struct<name:string>>>"))
    head = F.concat_ws("\n", F.concat(F.lit("### ["), F.coalesce("identifier", F.lit("")), F.lit("] "), F.coalesce("title", F.lit(""))), line("Status", F.coalesce("state.name", F.lit("None"))), line("Priority", F.coalesce(F.col("priority").cast("string"), F.lit("None"))), line("Assignee", F.coalesce("assignee.name", F.lit("Unassigned"))), line("Labels", F.coalesce(F.when(names != "", names), F.lit("None"))), line("URL", F.coalesce("url", F.lit(""))), F.lit(""), F.coalesce(F.when(F.col("description") != "", F.col("description")), F.lit("_No description._")))
    tail = F.when(F.size(comments) > 0, F.concat(F.lit("\n\n**Comments:**\n"), F.array_join(F.transform(comments, quote), "\n"))).otherwise("")
    return issue.select("id", F.concat(head, tail).alias("markdown"))


def block_line(kind: Column, text: Column, language: Column) -> Column:
    """Markdown of a block; unknown types are null."""
    return (
        F.when(kind == "heading_1", F.concat(F.lit("# "), text)).when(kind == "heading_2", F.concat(F.lit("## "), text)).when(kind == "heading_3", F.concat(F.lit("### "), text))
        .when(kind.isin("paragraph", "quote"), text).when(kind == "bulleted_list_item", F.concat(F.lit("- "), text)).when(kind == "numbered_list_item", F.concat(F.lit("1. "), text))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), text, F.lit("\n```"))).when(kind == "divider", "---").when(kind == "callout", F.concat(F.lit("> "), text))
    )


def blocks_markdown(blocks: DataFrame, page: str = "page", order: str = "pos") -> DataFrame:
    """``page, markdown`` of rows ``page, pos, type, text, language``."""
    rows = blocks.select(page, order, block_line(F.col("type"), F.coalesce("text", F.lit("")), F.col("language")).alias("line")).where("line IS NOT NULL")
    return rows.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n\n").alias("markdown"))


def sections(text: Column) -> Column:
    """Map of ``## `` headings to their bodies; of equal headings the last; text before the first is left out."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), r"\r?\n## "), 2, 2**30)
    heads = F.transform(parts, lambda p: strip(F.substring_index(p, "\n", 1)))
    bodies = F.transform(parts, lambda p: strip(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 1, F.length(p))))
    both = F.arrays_zip(heads.alias("h"), bodies.alias("b"))
    names = F.array_distinct(heads)
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(both, lambda z: z["h"] == n), -1)["b"]))


def field(text: Column, name: str) -> Column:
    """The value of a ``**name**:`` line: all that follows the line's first colon; empty without one."""
    line = F.try_element_at(F.filter(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.contains(x, F.lit(f"**{name}**:"))), F.lit(1))
    return F.coalesce(strip(F.substring(line, F.locate(":", line) + 1, F.length(line))), F.lit(""))


def session_notes(notes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Session-note records; front matter first, then sections. Notes without work are left out."""
    fm, body = M.note_fields(F.col(text)), M.body_after(F.col(text))
    rows = notes.select(key, fm.alias("fm"), sections(body).alias("s"))
    some = lambda c: F.when(c != "", c)
    get = lambda name: F.coalesce(F.try_element_at("s", F.lit(name)), F.lit(""))
    own = lambda k, alt: F.coalesce(some(F.try_element_at("fm", F.lit(k))), some(alt))
    out = rows.select(
        key, own("work", field(get("Position"), "Work")).alias("work"), own("status", field(get("Position"), "Status")).alias("status"), own("branch", field(get("Position"), "Branch")).alias("branch"),
        field(get("Position"), "Tests").alias("tests"), M.note_number(F.try_element_at("fm", F.lit("duration_min"))).alias("duration_min"), F.try_element_at("fm", F.lit("project")).alias("project"),
        M.note_flag(F.try_element_at("fm", F.lit("compacted"))).alias("compacted"), M.note_list(F.try_element_at("fm", F.lit("skills_invoked"))).alias("skills_invoked"),
        field(get("Metadata"), "Key tools").alias("key_tools"), field(get("Metadata"), "Files touched").alias("files_touched"), field(get("Metadata"), "Token hotspots").alias("token_hotspots"),
        *[get(h).alias(h.lower().replace(" ", "_")) for h in ("Gotchas", "Friction signals", "Attribution notes", "Skill candidates", "Session insights", "Open questions")],
    )
    return out.where("work IS NOT NULL")


def fenced_files(report: DataFrame, key: str, text: str) -> DataFrame:
    """``key, file, content`` of fenced blocks that are command files: front matter with a name."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)```[a-z]*\r?\n(---.*?)\r?\n```"), 1)
    rows = report.select(key, F.explode(bodies).alias("content"))
    name = F.replace(strip(F.regexp_replace(F.regexp_extract("content", r"(?m)^\s*name:[ \t]*(.*)$", 1), '"', "")), F.lit(" "), F.lit("_"))
    return rows.select(key, F.concat(name, F.lit(".md")).alias("file"), "content").where("file <> '.md'")


def note_markdown(notes: DataFrame) -> DataFrame:
    head = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("title", "source", "topic")], F.concat(F.lit("tags: ["), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "), F.lit("]")), *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("date", "relevance", "source_file", "pages")], F.lit("---\n\n"))
    return notes.select("note_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("markdown"))


def note_problems(notes: DataFrame, sources: tuple[str, ...] = ("book-chapter", "paper", "course", "article")) -> DataFrame:
    """Rows that break a rule, with the rules broken: relevance within 1..5, known source."""
    bad = F.array_compact(F.array(F.when(~F.coalesce(F.col("relevance").between(1, 5), F.lit(False)), "relevance"), F.when(~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "source")))
    return notes.select("note_id", bad.alias("broken")).where(F.size("broken") > 0)


def source_type(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.when(F.exists(parts, lambda p: F.contains(p, F.lit("course")) | F.contains(p, F.lit("lecture"))), "course").when(F.exists(parts, lambda p: p.rlike(r"^[0-3]\.")), "book-chapter").otherwise("paper")


def topic_of(path: Column, topics: dict[str, str]) -> Column:
    """Topic of the first path part that is a known folder; null without one."""
    table = F.create_map(*[F.lit(x) for kv in topics.items() for x in kv])
    return F.try_element_at(F.filter(F.transform(F.split(path, "/"), lambda p: table[p]), lambda t: t.isNotNull()), F.lit(1))


def with_link(pages: DataFrame, page: str, target: str) -> DataFrame:
    """Pages with ``- [[target]]`` under ``## See Also`` of one page, added once."""
    c = F.when(F.contains("content", F.lit("## See Also")), F.col("content")).otherwise(F.concat("content", F.lit("\n\n## See Also\n")))
    c = F.when(F.contains(c, F.lit(f"[[{target}]]")), c).otherwise(F.concat(c, F.lit(f"- [[{target}]]\n")))
    return pages.withColumn("content", F.when(F.col("id") == page, c).otherwise(F.col("content")))


def skeleton(stats: DataFrame) -> DataFrame:
    """A note for each session that has none."""
    line = lambda label, c: F.concat(F.lit(f"- **{label}**: "), F.coalesce(c.cast("string"), F.lit("-")))
    return stats.select("session_id", F.concat_ws("\n", F.concat(F.lit("# Session "), F.col("session_id")), F.lit(""), F.lit("## Position"), line("Work", F.substring("first_prompt", 1, 120)), line("Duration", F.col("duration_minutes")), F.lit(""), F.lit("## Metadata"), line("Files touched", F.col("files_modified")), line("Model", F.col("primary_model")), F.lit("")).alias("markdown"))


def comparison(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, left, right, gap``: one row per field of records in both tables."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").cast("string").alias("left"), F.col(f"r.{f}").cast("string").alias("right")) for f in fields]))
    both = left.alias("l").join(right.alias("r"), key)
    return both.select(F.col(f"l.{key}").alias(key), cells.alias("c")).select(key, "c.*", F.when(F.coalesce(F.length("c.right"), F.lit(0)) > 0, "✓").otherwise("⚠").alias("gap"))


def folded_messages(messages: DataFrame, by: str, order: str, text: str, from_: int = 8, keep: int = 4) -> DataFrame:
    """Histories of at least ``from_`` messages: all but the last ``keep`` as one text; ``by, older, kept``."""
    rows = messages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("m"))
    cut = F.when(F.size("m") >= from_, F.size("m") - keep).otherwise(0)
    texts = lambda a: F.transform(a, lambda x: x[text])
    return rows.select(by, F.array_join(texts(F.slice("m", 1, cut)), "\n").alias("older"), texts(F.slice("m", cut + 1, F.size("m"))).alias("kept"))


def mapped(rows: DataFrame, text: str, make, out: str = "reply") -> DataFrame:
    """Rows with ``make()`` (called once per worker) applied to batches of texts: embedding, generation, classification.

    ``make`` returns a function from a list of texts to a list of texts; a model is loaded in it, a stub in tests.
    """
    import pandas as pd
    from pyspark.sql import types as T

    def run(batches):
        model = make()
        for b in batches:
            yield pd.Series(model(b.tolist()), dtype=object)

    return rows.withColumn(out, F.pandas_udf(run, T.StringType(), F.PandasUDFType.SCALAR_ITER)(text))


def embedded(rows: DataFrame, text: str, make, out: str = "vector") -> DataFrame:
    """As ``mapped``, to vectors of length 1 (a zero vector stays)."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    def run(batches):
        model = make()
        for b in batches:
            v = np.asarray(model(b.tolist()), np.float32).reshape(len(b), -1)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(v / np.where(norm == 0, 1, norm)))

    return rows.withColumn(out, F.pandas_udf(run, T.ArrayType(T.FloatType()), F.PandasUDFType.SCALAR_ITER)(text))
