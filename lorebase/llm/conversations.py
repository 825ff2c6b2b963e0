"""Rebuilding conversations from message rows.

Rows are sessionized by a channel (a session id, participants, any expression): sorted by instant, optionally split at an
inactivity gap calibrated on the data, given speakers, and kept only if every user turn is answered. Ordering is a
range partitioning by (channel, instant, event), so one channel that holds a third of all rows is spread over many
tasks; what crosses a partition border is settled on one summary row per channel (or conversation) and partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.ranking import FRAGMENT, MARK, ordered_fragments, segments, silences
from lorebase.plans.staging import stage

BLOCKS = "array<struct<type:string,text:string>>"
VISIBLE_BLOCKS = ("text", "input_text", "output_text")
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*(Z|z|[+-]\d{2}(:?\d{2})?)?)?$"


def instant(stamp: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 time (any offset, UTC without one) or of a number of milliseconds.

    Null for null, blank, unreadable and impossible times.
    """
    bare = F.trim(stamp)
    iso = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2"), r"(:\d{2}(?:\.\d+)?|:\d{2}) ?([+-]\d{2})$", "$1$2:00")
    whole = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(bare, F.lit("T00:00:00Z"))).when(iso.rlike(r"([Zz]|[+-]\d{2}:\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    millis = F.when(bare.rlike(r"^\d{11,14}$"), bare.try_cast("bigint") * 1000)
    return F.coalesce(millis, F.when(bare.rlike(ISO), F.unix_micros(whole.try_cast("timestamp"))))


def speaker(kind: Column, role: Column) -> Column:
    """user or assistant, from the type, or from the role where the type is ``message``; else null."""
    named = F.when(F.lower(F.trim(kind)) == "message", F.lower(F.trim(role))).otherwise(F.lower(F.trim(kind)))
    return F.when(named.isin("user", "assistant"), named)


def parsed_events(events: DataFrame, channel: Column) -> DataFrame:
    """channel, event_id, speaker, at, h1, h2 (digests of the content), visible, broken: one row per event_id.

    Of several deliveries of an event the greatest channel counts, so one without a channel gives way to one with it.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    said = events.select(channel.cast("string").alias("channel"), F.col("event_id"), speaker(F.col("type"), F.col("role")).alias("speaker"), instant(F.col("timestamp")).alias("at"), content.alias("content"))
    said = said.where(F.col("speaker").isNotNull() & F.col("event_id").isNotNull())
    array = F.col("content").startswith("[{")
    # a JSON value that ends before the text does is no array of blocks either
    sound = F.try_parse_json(F.col("content")).isNotNull() & F.rtrim(F.col("content")).endswith("]")
    blocks = F.from_json(F.col("content"), BLOCKS)
    texts = F.transform(F.filter(blocks, lambda b: b["type"].isin(*VISIBLE_BLOCKS)), lambda b: F.coalesce(b["text"], F.lit("")))
    said = said.withColumn("broken", array & ~sound).withColumn("shown", F.when(array & sound, F.coalesce(F.array_join(texts, "\n"), F.lit(""))).when(~array, F.col("content")).otherwise(F.lit("")))
    bare = F.regexp_replace("shown", r"(?U)^\s+|\s+$", "")
    tag = F.regexp_extract(bare, r"^<([A-Za-z_][\w.:-]*)[^<>]*>", 1)
    closing = F.concat(F.lit("</"), tag, F.lit(">"))
    element = (tag != "") & bare.endswith(closing) & (F.locate("</", bare) > 0) & (F.expr("instr(_bare, _closing) + length(_closing) - 1 = length(_bare)"))
    said = said.withColumn("_bare", bare).withColumn("_closing", closing)
    visible = (F.col("_bare") != "") & ~F.coalesce(element, F.lit(False))
    said = said.select("channel", "event_id", "speaker", "at", F.xxhash64("content").alias("h1"), F.hash("content").alias("h2"), visible.alias("visible"), "broken")
    one = F.min(F.struct("speaker", "at", "h1", "h2", "visible", "broken"))
    return said.groupBy("event_id").agg(F.max("channel").alias("channel"), one.alias("_e")).select("event_id", "channel", "_e.*").where("channel IS NOT NULL")


BINS = 120  # quarters of a doubling, from a second on


def valley(counts: dict[int, int], least_bin: int) -> int | None:
    """The bin between the main mode of a histogram and the most prominent later one from ``least_bin`` on.

    Counts are smoothed over three bins. The later mode must rise by half of its height over the lowest bin between;
    the middle of the lowest bins is taken. None: there is no such mode.
    """
    at = lambda b: counts.get(b, 0)
    smooth = [at(b - 1) + 2 * at(b) + at(b + 1) for b in range(BINS)]
    top = max(range(BINS), key=lambda b: (smooth[b], -b))
    best = None
    for b in range(max(top + 2, least_bin), BINS):
        low = min(smooth[top + 1 : b])
        if smooth[b] and 2 * (smooth[b] - low) >= smooth[b] and (best is None or smooth[b] - low > best[0]):
            lowest = [i for i in range(top + 1, b) if smooth[i] == low]
            best = (smooth[b] - low, (lowest[0] + lowest[-1]) // 2)
    return best and best[1]


def calibrated_gap(rows: DataFrame, least_s: int = 1800) -> int | None:
    """Seconds of silence that end a conversation: where the histogram of the logarithms of all silences between a
    channel's neighbouring rows has its valley between turns and pauses; ``least_s`` at least. None: there are no pauses.

    ``rows``: ordered fragments. Silences across the borders of fragments count. At most BINS rows come to the driver.
    """
    gaps = silences(rows.where("at >= 0"), ["channel"], "at")
    # half a microsecond more, so that no silence lies on the border of two bins
    bins = F.floor(4 * F.log2((F.col("gap") + 0.5) / 1e6)).cast("int")
    counted = gaps.where("gap >= 1000000").groupBy(F.least(bins, F.lit(BINS - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    found = valley({r["b"]: r["n"] for r in counted.collect()}, int(4 * math.log2(max(1, least_s))))
    return None if found is None else max(least_s, int(2 ** (found / 4)))


def rebuild(events: DataFrame, channel: str | Column = "session_id", split: bool = False, least_s: int = 1800) -> DataFrame:
    """Kept conversations as rows ``channel, segment, pos, event_id, speaker, at``.

    ``split=False``: a channel is one conversation (segment 0). ``split=True``: it is cut where the silence exceeds the
    calibrated gap (``least_s`` at least). Dropped: conversations without a message, not begun by the user, with a user
    message that no assistant message follows directly, with a damaged block array, or with a message of unknown time;
    if channels are split, such a message could belong to any conversation of its channel, and all of them go. Rows
    without a channel belong to none; repeated deliveries count once; equal messages (speaker, instant, content) are the
    one of the smallest event_id; equal instants are ordered by event_id. Null content is blank; rows without an
    event_id are left out. An empty table gives no rows.
    """
    parsed = parsed_events(events, F.col(channel) if isinstance(channel, str) else channel).where("visible OR broken")
    bad = F.col("broken") | F.col("at").isNull()
    once = parsed.groupBy("channel", "speaker", F.coalesce("at", F.lit(-1)).alias("at"), "h1", "h2", bad.alias("bad")).agg(F.min("event_id").alias("event_id")).drop("h1", "h2")
    # written before the range partitioning, which looks at its input twice
    rows = ordered_fragments(stage(once, "parsed"), ["channel"], ["at", "event_id"], "messages")
    gap = calibrated_gap(rows, least_s) if split else None
    rows = rows.withColumn("segment", F.lit(0).cast("long")) if gap is None else segments(rows, ["channel"], "at", gap * 1_000_000)
    talk = ["channel", "segment"]
    follows = F.lead("speaker").over(Window.partitionBy(*talk, FRAGMENT).orderBy(MARK))
    rows = rows.withColumn("_open", (F.col("speaker") == "user") & (follows == "user"))
    pieces = rows.groupBy(*talk, FRAGMENT).agg(
        F.count(F.lit(1)).alias("n"), F.min(MARK).alias("first_mark"),
        F.min(F.struct(MARK, "speaker"))["speaker"].alias("opens"), F.max(F.struct(MARK, "speaker"))["speaker"].alias("ends"),
        (F.max("bad") | F.coalesce(F.max("_open"), F.lit(False))).alias("bad"),
    )
    along = Window.partitionBy(*talk).orderBy(FRAGMENT)  # a row per range partition that the conversation reaches
    unanswered = (F.col("ends") == "user") & F.coalesce(F.lead("opens").over(along) == "user", F.lit(True))
    pieces = pieces.withColumn("_bad", F.col("bad") | unanswered | (F.lag("n").over(along).isNull() & (F.col("opens") != "user")))
    pieces = pieces.withColumn("_drop", F.max("_bad").over(Window.partitionBy(*talk))).withColumn("before", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = pieces.where("NOT _drop").select(*talk, FRAGMENT, "first_mark", "before")
    if gap is not None:
        kept = kept.join(rows.where("at < 0").select("channel").distinct(), "channel", "left_anti")
    pos = F.col(MARK) - F.col("first_mark") + F.col("before") + 1
    return rows.join(kept, [*talk, FRAGMENT]).select("channel", F.col("segment").cast("int").alias("segment"), pos.alias("pos"), "event_id", "speaker", "at")


def participants() -> Column:
    """The channel of a row: its session, or the working directory where it names none."""
    return F.coalesce(F.concat(F.lit("session "), F.col("session_id")), F.concat(F.lit("folder "), F.col("cwd")))
