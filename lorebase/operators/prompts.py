"""What goes into models and comes out of them: prompts of the second tool, texts to embed, assembled prompts, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions import text as X
from lorebase.operators.usage import blocks


def tool_prompts(events: DataFrame, least: int = 20, cut: int = 300) -> DataFrame:
    """``event_id, session_id, prompt`` of the second tool's user messages (``type`` message, ``role`` user).

    The first ``input_text`` block counts that is longer than ``least``, tells no environment, and is still longer than
    ``least`` without the editor's heading. Contents that are no array of blocks give none.
    """
    said = events.where((F.col("type") == "message") & (F.col("role") == "user") & F.col("content").startswith("["))
    texts = F.transform(F.filter(blocks(F.col("content")), lambda b: b["type"] == "input_text"), lambda b: X.strip(F.coalesce(b["text"], F.lit(""))))
    whole = F.filter(texts, lambda t: (F.length(t) > least) & ~t.startswith("<environment_context"))
    clean = F.filter(F.transform(whole, X.without_editor_context), lambda t: F.length(t) > least)
    return said.select("event_id", "session_id", F.substring(F.try_element_at(clean, F.lit(1)), 1, cut).alias("prompt")).where("prompt IS NOT NULL")


def embedding_text(title: Column, summary: Column, body: Column, size: int = 600) -> Column:
    """Title, summary and the beginning of the body, as they go to an embedder; nulls are empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(text(title), F.lit(". "), text(summary), F.lit("\n\n"), F.substring(text(body), 1, size))


def reply_fields(reply: Column, allowed: dict[str, tuple[str, ...]]) -> Column:
    """The fields of a JSON reply, with or without a code fence, as a struct; null if it doesn't parse or a field has
    a value that isn't allowed."""
    found = F.from_json(X.unfenced(reply), ", ".join(f"`{name}` string" for name in allowed))
    valid = F.lit(True)
    for name, values in allowed.items():
        valid = valid & F.coalesce(found[name].isin(*values), F.lit(False))
    return F.when(valid, found)


def sections(parts: list[tuple[str, Column]]) -> Column:
    """A prompt of headed sections; those without text are left out."""
    made = [F.when(X.strip(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"## {head}\n"), X.strip(c))) for head, c in parts]
    return F.concat_ws("\n\n", *made)


def merge_prompts(notes: DataFrame, by: str, order: str, text: str, most: int = 40) -> DataFrame:
    """``by, prompt, left_out``: the notes of a source in order, numbered, for one merging prompt; the first ``most``.

    What is over goes to a further round (``left_out`` counts it), so no prompt grows with its source.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    rows = notes.where(F.col(text).isNotNull()).select(by, order, text).withColumn("_n", F.row_number().over(w))
    line = F.concat(F.lit("### Note "), F.col("_n").cast("string"), F.lit("\n"), F.col(text))
    made = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", line.alias("t"))))).alias("ts"), F.count_if(F.col("_n") > most).alias("left_out"))
    return made.select(by, F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n").alias("prompt"), "left_out")


def reranked(candidates: DataFrame, ranks: DataFrame, by: str, key: str, place: str, fallback: float = 0.5) -> DataFrame:
    """``by, key, position, score`` of candidates in the order that a reranker gave; those it left out follow in their
    own order with the ``fallback`` score, as all do if it gave none.

    ``ranks``: by, key, rank, score; of several ranks of a key the least counts. Groups are result lists of a query.
    """
    from pyspark.sql import Window

    best = ranks.where("rank IS NOT NULL").groupBy(by, key).agg(F.min(F.struct("rank", "score")).alias("_b"))
    rows = candidates.join(best, [by, key], "left")
    w = Window.partitionBy(by).orderBy(F.asc_nulls_last("_b.rank"), place, key)
    return rows.select(by, key, F.row_number().over(w).alias("position"), F.coalesce("_b.score", F.lit(fallback)).alias("score"))
