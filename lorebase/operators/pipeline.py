"""Smaller steps of the document and review pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import frontmatter as M
from lorebase.functions import text as X
from lorebase.operators.search import stem


def last_messages(events: DataFrame, n: int = 8, longer: int = 5, cut: int = 300) -> DataFrame:
    """``session_id, messages``: the last ``n`` user texts of more than ``longer`` characters, cut, in order.

    ``events``: session_id, event_id, text. At most ``n`` rows of a session are gathered.
    """
    clean = events.select("session_id", "event_id", F.substring(X.strip(X.without_elements(F.col("text"))), 1, cut).alias("t")).where(F.length("t") > longer)
    top = clean.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("event_id")))).where(F.col("_r") <= n)
    return top.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "t"))), lambda x: x["t"]).alias("messages"))


def commands(files: DataFrame) -> DataFrame:
    """``name, description`` of command files ``path, text``."""
    return files.select(stem(F.col("path")).alias("name"), M.command_description(F.col("text")).alias("description"))


def newest(files: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` files with the greatest names, before any parsing."""
    return files.orderBy(F.desc(stem(F.col("path")))).limit(n)


def with_default(rows: DataFrame, lookup: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Left join with a lookup; rows without a match take the value of the default key."""
    fallback = lookup.where(F.col(key) == default).agg(F.max(value).alias("_default"))
    out = rows.join(lookup.select(F.col(key).alias("_k"), F.col(value).alias("_v")), F.col(key) == F.col("_k"), "left").join(F.broadcast(fallback), F.lit(True))
    return out.select(*[rows[c] for c in rows.columns], F.coalesce("_v", "_default").alias(value))


def slide_routes(slides: DataFrame, images: DataFrame, plain: tuple[str, ...] = ("title", "bullets", "closing")) -> DataFrame:
    """``slide, route``: image slides that have an image are ``image``, all others ``text``."""
    have = images.select("slide", F.lit(True).alias("_i")).distinct()
    return slides.join(have, "slide", "left").select("slide", F.when(F.col("kind").isin(*plain), "text").when(F.col("_i"), "image").otherwise("text").alias("route"))


def routed(query: Column, rules: list[tuple[str, str]], default: str = "retrieve") -> Column:
    """The name of the first rule whose pattern is found in the text."""
    out = None
    for pattern, name in rules:
        out = (F.when if out is None else out.when)(F.lower(query).rlike(pattern), name)
    return out.otherwise(default) if out is not None else F.lit(default)


def review_sample(rows: DataFrame, key: str, stratum: str, share: float = 0.05, signal: Column | None = None) -> DataFrame:
    """A share of each stratum by a hash of the key (the same rows on every run), and all rows with a signal."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit("review "), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    chosen = F.coalesce(number % 10_000 < int(share * 10_000), F.lit(False))
    why = F.when(signal, "signal").when(chosen, "sample") if signal is not None else F.when(chosen, "sample")
    return rows.withColumn("reason", why).where("reason IS NOT NULL").select(key, stratum, "reason")


def visibility(nodes: DataFrame, highlight: DataFrame | None, focus: DataFrame | None, filtered: DataFrame | None) -> DataFrame:
    """``id, state``: highlights first, then focus, then the tag filter; without any all nodes are shown."""
    out = nodes.select("id").distinct()
    state = F.lit("shown")
    for name, other, rest in (("filtered", filtered, "hidden"), ("focus", focus, "hidden"), ("highlight", highlight, "dimmed")):
        if other is not None:
            out = out.join(other.select("id", F.lit(True).alias(f"_{name}")).distinct(), "id", "left")
            state = F.when(F.col(f"_{name}"), "shown").otherwise(rest)
    return out.select("id", state.alias("state"))


def prompt_summary(stats: DataFrame, prompts: int = 30, tools: int = 3) -> DataFrame:
    """``session_id, line``: one line per session for a report prompt; the newest ``prompts`` sessions."""
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce("tool_counts", F.create_map().cast("map<string,bigint>"))), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    top = F.array_join(F.transform(F.slice(entries, 1, tools), lambda e: F.concat(e["k"], F.lit("×"), (-e["n"]).cast("string"))), ", ")
    return stats.orderBy(F.desc("start_us")).limit(prompts).select("session_id", F.concat_ws(" | ", F.substring("first_prompt", 1, 120), top).alias("line"))


def envelope(text: Column, most: int = 4000, blocked: str = r"(?i)ignore (all|previous) instructions|system prompt:") -> Column:
    """Input guard: ``ok, reason, text`` of a query, with white space folded and simple personal data masked."""
    folded = X.strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    reason = F.when(folded == "", "empty").when(F.length(folded) > most, "too long").when(folded.rlike(blocked), "blocked")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), X.redact_simple(folded).alias("text"))


def upserted_messages(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """State merge by message id: new messages replace old ones of the same id, the others are appended."""
    from lorebase.operators.ledgers import merged

    return merged(old, new, [key])
