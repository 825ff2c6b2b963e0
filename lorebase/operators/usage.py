"""Usage analytics over session events: per-session statistics, aggregates, overlaps, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import numbers as N
from lorebase.functions import text as X
from lorebase.operators.ranking import ordered_fragments, segments, silences, with_position
from lorebase.plans.staging import stage

BLOCK = "array<struct<type:string,name:string,text:string,is_error:boolean,content:string,input:struct<file_path:string,path:string,command:string>>>"
# fixed values: shell commands for which there is a tool; bounds and names of response time buckets
SHELL_MISUSE = r"\bcat\s+\S|\bhead\s|\btail\s|\bsed\s|\bawk\s|\bgrep\s|\brg\s|\bfind\s+\.|\bls\s|\bwc\s"
RESPONSE_BUCKETS = ((10, "2-10s"), (30, "10-30s"), (60, "30s-1m"), (120, "1-2m"), (300, "2-5m"), (900, "5-15m"), (None, ">15m"))


def blocks(content: Column) -> Column:
    """The blocks of a content that is a JSON array; a single object is one block; plain text none."""
    return F.when(content.startswith("["), F.from_json(content, BLOCK)).when(content.startswith("{"), F.from_json(F.concat(F.lit("["), content, F.lit("]")), BLOCK))


def plain_text(content: Column) -> Column:
    """A text content as it is; of blocks the texts of text blocks, joined by a blank."""
    texts = F.transform(F.filter(blocks(content), lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.when(content.startswith("[{") | content.startswith("{"), F.coalesce(F.array_join(texts, " "), F.lit(""))).otherwise(F.coalesce(content, F.lit("")))


def error_class(text: Column) -> Column:
    """Class of a failed tool result; the first rule that holds counts."""
    t = F.lower(text)
    has = lambda *words: F.greatest(*[F.contains(t, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(t, F.lit(words[0]))
    return F.when(has("no such file", "not found"), "file_not_found").when(has("permission"), "permission_denied").when(has("rejected"), "user_rejected").when(has("failed", "exit code"), "command_failed").when(has("too large", "too long"), "file_too_large").when(has("edit"), "edit_failed").otherwise("other")


def tool_calls(events: DataFrame) -> DataFrame:
    """``session_id, event_id, name, path, command`` of each tool use."""
    each = events.select("session_id", "event_id", F.explode(blocks(F.col("content"))).alias("b")).where("b.type = 'tool_use'")
    return each.select("session_id", "event_id", F.coalesce("b.name", F.lit("unknown")).alias("name"), F.coalesce("b.input.file_path", "b.input.path").alias("path"), F.col("b.input.command").alias("command"))


def tool_failures(events: DataFrame) -> DataFrame:
    each = events.select("session_id", "event_id", F.explode(blocks(F.col("content"))).alias("b")).where("b.type = 'tool_result' AND b.is_error")
    return each.select("session_id", "event_id", error_class(F.coalesce("b.content", F.lit(""))).alias("class"))


def count_map(rows: DataFrame, by: str, key: str, name: str) -> DataFrame:
    """Counts per key as a map, by two aggregations: no group's rows are gathered, only its distinct keys."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(by, key).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))


def merge_maps(rows: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """``key, n``: sums of map values over all rows, greatest first, ties by key."""
    out = rows.select(F.explode(column).alias("key", "v")).groupBy("key").agg(F.sum("v").alias("n"))
    return out.orderBy(F.desc("n"), "key").limit(limit) if limit else out


def primary(rows: DataFrame, by: str, key: str, order: str) -> DataFrame:
    """The most frequent key of each group, ties to the one seen first."""
    n = rows.where(F.col(key).isNotNull()).groupBy(by, key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max(F.struct("n", F.struct((-F.unix_micros("first") if dict(rows.dtypes)[order].startswith("timestamp") else -F.col("first")).alias("f")), key)).alias("b")
    return n.groupBy(by).agg(best).select(by, F.col(f"b.{key}").alias(key), F.col("b.n").alias("n"))


def gaps(rows: DataFrame, by: str, at: str, low: float = 1.0, high: float = 7200.0) -> DataFrame:
    """``by, gap``: seconds between neighbouring rows of a group, between ``low`` and ``high`` (both excluded).

    ``at`` is a number of microseconds; rows without are left out. Rows are ordered by range partitions, so no group is
    gathered, whatever its size.
    """
    ordered = ordered_fragments(rows.where(F.col(at).isNotNull() & F.col(by).isNotNull()).select(by, at), [by], [at], "gaps")
    return silences(ordered, [by], at).select(by, (F.col("gap") / 1e6).alias("gap")).where((F.col("gap") > low) & (F.col("gap") < high))


def sessions_by_silence(rows: DataFrame, by: str, at: str, tie: str, silence_us: int) -> DataFrame:
    """``by, session, events, start_us``: the parts of each group between silences of more than ``silence_us``; ``at`` in
    microseconds, equal times are ordered by ``tie``; sessions are numbered from 1."""
    ordered = ordered_fragments(rows.where(F.col(at).isNotNull()).select(by, at, tie), [by], [at, tie], "sessions")
    cut = segments(ordered, [by], at, silence_us)
    return cut.groupBy(by, (F.col("segment") + 1).alias("session")).agg(F.count(F.lit(1)).alias("events"), F.min(at).alias("start_us"))


def response_bucket(gap: Column) -> Column:
    out = F.when(gap < RESPONSE_BUCKETS[0][0], RESPONSE_BUCKETS[0][1])
    for bound, name in RESPONSE_BUCKETS[1:-1]:
        out = out.when(gap < bound, name)
    return out.otherwise(RESPONSE_BUCKETS[-1][1])


def response_histogram(gap_rows: DataFrame) -> DataFrame:
    """``bucket, n`` with all seven buckets."""
    spark = gap_rows.sparkSession
    names = spark.createDataFrame([(n,) for _, n in RESPONSE_BUCKETS], "bucket string")
    counted = gap_rows.groupBy(response_bucket(F.col("gap")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def rank_percentiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: the values at position ``floor(n * share)`` of the ascending values, by a distributed ranking."""
    ranked = with_position(rows.select(F.lit(0).alias("_g"), F.col(value).alias("_v")).where("_v IS NOT NULL"), ["_g"], ["_v"], "_pos", "percentiles")
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    at = ranked.join(F.broadcast(n), F.lit(True))  # one row
    return at.agg(*[F.max(F.when(F.col("_pos") == F.floor(F.col("_n") * F.lit(s)) + 1, F.col("_v"))).alias(k) for k, s in shares.items()])


def overlaps(sessions: DataFrame, bucket_s: int = 86400) -> DataFrame:
    """Pairs ``a, b`` of ``id, start, stop`` (seconds) where b starts after a and no later than a stops; ties by id.

    Each session enters the time buckets it spans, a start only its own bucket: an equi join on the bucket instead of a
    comparison of all with all.
    """
    open_ = sessions.select(F.col("id").alias("a"), F.col("start").alias("a_start"), F.col("stop").alias("a_stop"), F.explode(F.sequence(F.floor(F.col("start") / bucket_s), F.floor(F.col("stop") / bucket_s))).alias("k"))
    begun = sessions.select(F.col("id").alias("b"), F.col("start").alias("b_start"), F.floor(F.col("start") / bucket_s).alias("k"))
    later = (F.col("b_start") > F.col("a_start")) | ((F.col("b_start") == F.col("a_start")) & (F.col("b") > F.col("a")))
    return open_.join(begun, "k").where(later & (F.col("b_start") <= F.col("a_stop"))).select("a", "b")


def _read(events: DataFrame, **more: Column) -> DataFrame:
    """What the statistics need of each event, without its content."""
    text = X.strip(X.without_elements(plain_text(F.col("content"))))
    file = F.when(F.col("type") == "file-history-snapshot", F.get_json_object("content", "$.fileId"))
    return events.select("session_id", "event_id", "speaker", "at", "cwd", "model", "usage", F.when(F.col("speaker") == "user", F.substring(text, 1, 200)).alias("_text"), file.alias("_file"), *[c.alias(name) for name, c in more.items()])


def _summed(read: DataFrame) -> DataFrame:
    user, assistant = F.col("speaker") == "user", F.col("speaker") == "assistant"
    first = F.min(F.when((F.col("_text") != "") & F.col("at").isNotNull(), F.struct("at", "event_id", F.col("_text").alias("t"))))
    base = read.groupBy("session_id").agg(
        F.min("cwd").alias("project_path"), F.min(F.when(user, F.col("at"))).alias("start_us"), F.max(F.when(user, F.col("at"))).alias("end_us"),
        F.count_if(user).alias("user_messages"), F.count_if(assistant).alias("assistant_messages"),
        F.sum(F.when(assistant, F.coalesce("usage.input_tokens", F.lit(0))).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(assistant, F.coalesce("usage.output_tokens", F.lit(0))).otherwise(0)).alias("output_tokens"),
        first["t"].alias("first_prompt"), F.count_distinct("_file").alias("files_modified"),
    ).where("start_us IS NOT NULL")
    return base.withColumn("duration_minutes", F.bround((F.col("end_us") - F.col("start_us")) / 6e7, 1))


def message_statistics(events: DataFrame) -> DataFrame:
    """``session_id, project_path, start_us, end_us, user_messages, assistant_messages, input_tokens, output_tokens,
    first_prompt, files_modified, duration_minutes`` by one aggregation; for the input see ``session_statistics``."""
    return _summed(_read(events))


def session_statistics(events: DataFrame) -> DataFrame:
    """One row per session: counts, tokens, span, tools, errors, languages, files, first prompt, skills, signals.

    Needs ``session_id, event_id, speaker, at`` (microseconds, null if unknown) ``, content, model, usage, type, cwd``. A
    session without a user message of known time is left out. Ratios are null where the divisor is 0.
    """
    user, assistant = F.col("speaker") == "user", F.col("speaker") == "assistant"
    # everything that is counted by a key, in one pass: (kind, key) of each block, model and command
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    made = assistant | (F.col("type") == "tool_call")

    def keys(b: Column) -> Column:
        name, used = F.coalesce(b["name"], F.lit("unknown")), made & (b["type"] == "tool_use")
        shell = used & (name == "Bash") & F.coalesce(b["input"]["command"].rlike(SHELL_MISUSE), F.lit(False))
        language = X.language_of(F.coalesce(b["input"]["file_path"], b["input"]["path"]))
        failed = (b["type"] == "tool_result") & F.coalesce(b["is_error"], F.lit(False))
        return F.array(F.when(used, pair("tool", name)), F.when(used & language.isNotNull(), pair("language", language)), F.when(shell, pair("shell", F.lit(""))), F.when(failed, pair("error", error_class(F.coalesce(b["content"], F.lit(""))))))

    none = F.array().cast("array<struct<kind:string,key:string>>")
    skills = F.transform(X.slash_commands(X.without_elements(plain_text(F.col("content")))), lambda s: pair("skill", s))
    every = F.concat(F.coalesce(F.flatten(F.transform(blocks(F.col("content")), keys)), none), F.coalesce(F.when(user, skills), none), F.array(F.when(assistant & F.col("model").isNotNull(), pair("model", F.col("model")))))
    # written once, without the contents: three aggregations read it
    read = stage(_read(events, _keys=F.array_compact(every)), "session-events")
    base = _summed(read)
    counted = read.select("session_id", "event_id", F.explode("_keys").alias("p")).groupBy("session_id", "p.kind", "p.key").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    listed = counted.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("kind", "key", "n", "first"))).alias("k"))
    of = lambda kind: F.filter("k", lambda x: x["kind"] == kind)
    as_map = lambda kind: F.when(F.size(of(kind)) > 0, F.map_from_entries(F.transform(of(kind), lambda x: F.struct(x["key"], x["n"]))))
    total = lambda kind: F.aggregate(of(kind), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    count = lambda *names: F.aggregate(F.filter(of("tool"), lambda x: x["key"].isin(*names)), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    models = F.transform(F.filter(of("model"), lambda x: x["key"] != ""), lambda x: F.struct(x["n"].alias("n"), (-x["first"]).alias("f"), x["key"].alias("key")))
    keyed = listed.select(
        "session_id", total("shell").alias("shell_misuses"), count("Task").alias("task_calls"), count("TodoWrite").alias("todo_calls"), count("Read").alias("reads"), count("Edit", "Write", "MultiEdit").alias("edits"), total("skill").alias("skill_calls"),
        as_map("tool").alias("tool_counts"), as_map("language").alias("languages"), as_map("error").alias("tool_errors"), as_map("model").alias("models"), F.array_max(models)["key"].alias("primary_model"),
    )
    gap = gaps(read.where(user), "session_id", "at").groupBy("session_id").agg(F.count(F.lit(1)).alias("responses"), F.count_if(F.col("gap") < 5).alias("interruptions"))
    out = base.join(keyed, "session_id", "left").join(gap, "session_id", "left")
    out = out.fillna(0, ["shell_misuses", "task_calls", "todo_calls", "reads", "edits", "skill_calls", "responses", "interruptions"]).fillna({"primary_model": "unknown", "first_prompt": ""})
    return out.withColumns({
        "output_tokens_per_msg": F.bround(F.try_divide("output_tokens", "assistant_messages"), 1),
        "read_edit_ratio": F.bround(F.try_divide("reads", "edits"), 2),
        "cost": N.cost(F.col("primary_model"), [F.col("input_tokens"), F.col("output_tokens"), F.lit(0), F.lit(0)]),
    })


def friction(stats: DataFrame) -> DataFrame:
    """``session_id, signals``: rules on failures, shell share and interruptions, else ``None detected``."""
    count = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    total = F.greatest(F.aggregate(F.map_values(F.coalesce("tool_counts", F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(1))
    failures = count(F.col("tool_errors"), "edit_failed") + count(F.col("tool_errors"), "file_not_found")
    found = F.array_compact(F.array(F.when(failures > 2, "repeated tool failures"), F.when(count(F.col("tool_counts"), "Bash") / total > 0.6, "high shell usage"), F.when(F.col("interruptions") > 3, "frequent interruptions")))
    return stats.select("session_id", F.when(F.size(found) == 0, F.array(F.lit("None detected"))).otherwise(found).alias("signals"))


def totals(stats: DataFrame) -> DataFrame:
    """One row over all sessions."""
    return stats.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("user_messages").alias("user_messages"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count_distinct(F.to_date(F.timestamp_micros("start_us"))).alias("days_active"), F.count_if(F.col("task_calls") > 0).alias("task_agent_sessions"),
        F.count_if((F.col("duration_minutes") > 30) & (F.col("todo_calls") == 0)).alias("long_without_todo"), F.count_if(F.col("read_edit_ratio") < 1).alias("ratio_below_1"),
    )


def enriched(notes: DataFrame, meta: DataFrame) -> DataFrame:
    """Notes with their session's figures: by session id, else by the minute of the start; ``matched`` says how."""
    by_id = meta.select(F.col("session_id").alias("_id"), F.col("tokens").alias("_t1"))
    by_minute = meta.groupBy("minute").agg(F.min(F.struct("session_id", "tokens")).alias("_m"))
    out = notes.join(by_id, notes["session_id"] == F.col("_id"), "left").join(by_minute.withColumnRenamed("minute", "_minute"), notes["session_id"].isNull() & (notes["minute"] == F.col("_minute")), "left")
    return out.select(*[notes[c] for c in notes.columns], F.coalesce("_t1", "_m.tokens").alias("tokens"), F.when(F.col("_t1").isNotNull(), "id").when(F.col("_m").isNotNull(), "minute").otherwise("none").alias("matched"))
