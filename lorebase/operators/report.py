"""The usage report: parallel sessions, frequencies, costs, and the figures of a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions import numbers as N
from lorebase.functions import text as X
from lorebase.operators import usage as U
from lorebase.operators.ranking import with_position


def parallel_sessions(sessions: DataFrame) -> DataFrame:
    """One row over ``id, start, stop, messages``: ``overlap_events`` (pairs of which the later one starts no later than
    the earlier one stops), ``sessions_involved``, ``overlap_messages`` and ``pct_messages`` of all messages.

    Pairs are counted, not made: starts and stops are ranked together and by themselves, so that a session's rank tells
    how many are open when it starts and how many start before it stops. Ties go by id. Of an empty table all are 0.
    """
    start = sessions.select("id", "messages", F.col("start").alias("t"), F.lit(0).alias("kind"))
    stop = sessions.select("id", F.lit(None).cast("long").alias("messages"), F.col("stop").alias("t"), F.lit(1).alias("kind"))
    both = with_position(start.unionByName(stop).withColumn("_all", F.lit(0)), ["_all"], ["t", "kind", "id"], "p", "report-all")
    both = with_position(both, ["kind"], ["t", "id"], "r", "report-kind")
    # of a start: r starts and p - r stops up to it; of a stop: p - r starts up to it
    seen = both.groupBy("id").agg(
        F.max("messages").alias("messages"), F.max(F.when(F.col("kind") == 0, F.col("r"))).alias("begun"),
        F.max(F.when(F.col("kind") == 0, 2 * F.col("r") - F.col("p") - 1)).alias("open"), F.max(F.when(F.col("kind") == 1, F.col("p") - F.col("r"))).alias("later"),
    )
    involved = (F.col("open") > 0) | (F.col("later") > F.col("begun"))
    sums = seen.agg(F.coalesce(F.sum("open"), F.lit(0)).alias("overlap_events"), F.count_if(involved).alias("sessions_involved"), F.coalesce(F.sum(F.when(involved, F.col("messages"))), F.lit(0)).alias("overlap_messages"), F.sum("messages").alias("_all"))
    return sums.withColumn("pct_messages", F.coalesce(F.bround(F.try_divide(F.col("overlap_messages") * 100, F.col("_all")), 0), F.lit(0.0)).cast("long")).drop("_all")


def mean_response(gap_rows: DataFrame) -> DataFrame:
    """One row: the mean of ``gap`` to a tenth of a second, half to even; 0 without any."""
    return gap_rows.agg(F.coalesce(F.bround(F.avg("gap"), 1), F.lit(0.0)).alias("avg_response_time"))


def frequencies(rows: DataFrame, key: str, seen: str, limit: int | None = None) -> DataFrame:
    """``key, n`` by count, greatest first, ties in the order in which the keys were first seen; nulls are left out."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("_seen"))
    counted = counted.orderBy(F.desc("n"), "_seen", key)
    return (counted.limit(limit) if limit else counted).select(key, "n")


def skills(events: DataFrame) -> DataFrame:
    """``skill, event_id`` of each slash command in a user's text."""
    used = X.slash_commands(X.without_elements(U.plain_text(F.col("content"))))
    return events.where("speaker = 'user'").select("event_id", F.explode(used).alias("skill"))


def session_costs(events: DataFrame, prices=N.PRICES) -> DataFrame:
    """``session_id, day, project, model, input_tokens, output_tokens, prompts, cost`` of sessions with a user message of
    known time; the model is the most frequent one of the assistant's messages (``unknown`` without one)."""
    user, assistant = F.col("speaker") == "user", F.col("speaker") == "assistant"
    tokens = lambda c: F.sum(F.when(assistant, F.coalesce(c, F.lit(0))).otherwise(0))
    base = events.groupBy("session_id").agg(F.min(F.when(user, F.col("at"))).alias("start_us"), F.substring_index(F.max("cwd"), "/", -1).alias("project"), tokens("usage.input_tokens").alias("input_tokens"), tokens("usage.output_tokens").alias("output_tokens"), F.count_if(user).alias("prompts"))
    models = U.primary(events.where(assistant & (F.col("model") != "")), "session_id", "model", "event_id").select("session_id", "model")
    out = base.where("start_us IS NOT NULL").join(models, "session_id", "left").fillna({"model": "unknown"})
    cost = N.cost(F.col("model"), [F.col("input_tokens"), F.col("output_tokens")], prices)
    return out.select("session_id", F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd").alias("day"), "project", "model", "input_tokens", "output_tokens", "prompts", F.round(cost, 6).alias("cost"))


def since(costs: DataFrame, today: str, days: int = 7) -> DataFrame:
    """The sessions of the last ``days`` days up to ``today``."""
    return costs.where(F.date_diff(F.lit(today).cast("date"), F.col("day").cast("date")).between(0, days))


def cost_totals(costs: DataFrame) -> DataFrame:
    return costs.agg(F.count(F.lit(1)).alias("sessions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "prompts")], F.round(F.coalesce(F.sum(F.col("cost").cast("decimal(18,6)")), F.lit(0)), 2).cast("double").alias("cost"))


def top_costs(costs: DataFrame, n: int = 5) -> DataFrame:
    """``session_id, line``: the dearest sessions, ties by id, as lines of a report."""
    top = costs.orderBy(F.desc("cost"), "session_id").limit(n)
    line = F.format_string("%s [%s] [%s] $%.6f (%d prompts, %s in / %s out)", "day", F.coalesce("project", F.lit("unknown")), "model", "cost", "prompts", X.thousands(F.col("input_tokens")), X.thousands(F.col("output_tokens")))
    return top.select("session_id", line.alias("line"))


def base_figures(pages: DataFrame, sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: pages, ingested sources (``path`` of the manifest), those of ``sources`` that wait, wikilinks in the pages."""
    links = pages.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.size(X.wikilinks(F.coalesce("content", F.lit(""))))), F.lit(0)).alias("wikilinks"))
    known = manifest.select("path").distinct()
    waiting = sources.select("path").distinct().join(known, "path", "left_anti").agg(F.count(F.lit(1)).alias("pending"))
    ingested = known.agg(F.count(F.lit(1)).alias("ingested"))
    # rows of one row
    return links.join(F.broadcast(ingested), F.lit(True)).join(F.broadcast(waiting), F.lit(True))


def comparison_day(sessions: DataFrame, notes: DataFrame) -> DataFrame:
    """``day, session_id, note_id, state``: for each day the last session and the last note of it, and which are there.

    ``sessions``: session_id, day, start; ``notes``: note_id, day. Of several on a day the greatest (start, id) counts.
    """
    last = sessions.groupBy("day").agg(F.max(F.struct("start", "session_id"))["session_id"].alias("session_id"))
    note = notes.groupBy("day").agg(F.max("note_id").alias("note_id"))
    state = F.when(F.col("session_id").isNull(), "note only").when(F.col("note_id").isNull(), "session only").otherwise("both")
    return last.join(note, "day", "full").select("day", "session_id", "note_id", state.alias("state"))


def percent(share: Column) -> Column:
    """A share as whole percent, half to even."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))
