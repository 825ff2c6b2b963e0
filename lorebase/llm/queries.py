"""The pN_ queries. Every query reads whole tables and takes the operators' production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import abuse, conversations, cooccurrence, mixing, near_duplicates, personal, splitting, tokenizing
from lorebase.llm.common import table


DEMO_KEY = "lorebase-demo-key"


def surrogate_key(spark: SparkSession) -> str:
    """The secret of the surrogates: the session's ``spark.lorebase.surrogateKey``, else LOREBASE_SURROGATE_KEY, else one for tests."""
    return spark.conf.get("spark.lorebase.surrogateKey", os.environ.get("LOREBASE_SURROGATE_KEY", DEMO_KEY))


def _redacted(spark: SparkSession, folder: str, mode: str, with_text: bool) -> DataFrame:
    rows = personal.records(*(table(spark, folder, t) for t in ("pages", "session_events", "issues", "notes")))
    return personal.redact(rows, surrogate_key(spark), mode, with_text)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.found(_redacted(spark, folder, "surrogate", False))


def p1_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return _redacted(spark, folder, "surrogate", True)


def p1_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    return _redacted(spark, folder, "placeholder", True).select("src", "field", "record_key", "text")


def p1_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind the items, their surrogates, and how many of them clash: none should."""
    return personal.distinctness(_redacted(spark, folder, "surrogate", False))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.rebuild(table(spark, folder, "session_events")).select(F.col("channel").alias("session_id"), "pos", "event_id")


def p2_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations per session, of rows without one per working directory, cut at the calibrated silence."""
    talks = conversations.rebuild(table(spark, folder, "session_events"), conversations.participants(), split=True)
    return talks.select("channel", "segment", "pos", "event_id", "speaker")


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    records = cooccurrence.tag_records(table(spark, folder, "pages"), table(spark, folder, "nodes"))
    return cooccurrence.together(records).withColumnsRenamed({"item_a": "tag_a", "item_b": "tag_b"}).withColumns({c: F.round(c, 6) for c in ("lift", "pmi")})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pairs(spark, folder).select("src", "tag_a", "tag_b")


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(near_duplicates.page_records(table(spark, folder, "pages")), k=3, least=0.6)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.member_pairs(*_versions(spark, folder)).toDF("path_a", "path_b")


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(*_versions(spark, folder)).withColumnRenamed("key", "path")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.page_pieces(table(spark, folder, "pages")).unionByName(splitting.chunk_pieces(table(spark, folder, "chunks")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = splitting.page_pieces(table(spark, folder, "pages"), keep_small=False)
    return splitting.oversized(pages).unionByName(splitting.oversized(splitting.chunk_pieces(table(spark, folder, "chunks"))))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizing.encode(table(spark, folder, "documents"))


def _mixed(spark: SparkSession, folder: str, total: int | str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_targets")
    sizes = mixing.sized_documents(table(spark, folder, "documents"), targets)
    plan = mixing.plan_mixture(sizes, targets, total)
    return mixing.mixture(sizes, plan), plan


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder, mixing.CORPUS)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, folder, mixing.CORPUS))


def p7_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of a mixture of a given size, 100,000 tokens."""
    return mixing.shares(*_mixed(spark, folder, 100_000))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.score(table(spark, folder, "documents")).where("flagged AND doc_id IS NOT NULL").select("doc_id").distinct()


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.score(table(spark, folder, "documents"))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates(abuse.score(table(spark, folder, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_surrogates, p1_placeholders, p1_distinct, p2_found, p2_channels, p3_found, p3_pairs, p4_found, p4_groups, p5_found, p5_pieces, p6_ids, p7_mixture, p7_shares, p7_budget, p8_found, p8_scores, p8_rates)}
_DAY = """coalesce(try_cast(regexp_extract(updated, '^\\s*(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})', 1) AS INT) * 10000 + try_cast(regexp_extract(updated, '^\\s*(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})', 2) AS INT) * 100
    + try_cast(regexp_extract(updated, '^\\s*(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})', 3) AS INT), 0)"""
_CURRENT = f"""cur AS (SELECT path, tags, content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {_DAY} DESC, coalesce(updated, '') DESC, tags DESC NULLS LAST, content DESC NULLS LAST) AS rn FROM pages WHERE path IS NOT NULL) WHERE rn = 1)"""
_TAG = r"translate(regexp_replace(regexp_replace(regexp_replace(lower(t), '^[\s,]+|[\s,]+$', '', 'g'), '^#+', ''), '^[\s,]+|[\s,]+$', '', 'g'), '_', '-')"
_PAIRS = f"""WITH {_CURRENT},
rec AS (SELECT 'pages' AS src, path AS key, regexp_split_to_array(coalesce(tags, ''), '[\\s,;]+') AS ts FROM cur
    UNION ALL SELECT 'nodes', id, flatten(list(coalesce(data.tags, []))) FROM nodes WHERE id IS NOT NULL GROUP BY id),
n AS (SELECT src, count(*) AS n FROM rec GROUP BY src),
item AS (SELECT DISTINCT src, key, {_TAG} AS tag FROM (SELECT src, key, unnest(ts) AS t FROM rec) WHERE t IS NOT NULL AND {_TAG} <> ''),
one AS (SELECT src, tag, count(*) AS c FROM item GROUP BY 1, 2),
two AS (SELECT a.src, a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM item a JOIN item b ON a.src = b.src AND a.key = b.key AND a.tag < b.tag GROUP BY 1, 2, 3)
SELECT two.src, tag_a, tag_b FROM two JOIN n ON n.src = two.src JOIN one a ON a.src = two.src AND a.tag = tag_a JOIN one b ON b.src = two.src AND b.tag = tag_b
WHERE n_ab >= 3 AND n_ab * 1000 >= 2 * n AND n_ab * n >= 3 * a.c * b.c"""

_TALK = r"""WITH ev AS (SELECT DISTINCT ON (event_id) event_id, session_id, content, CASE WHEN lower(trim(type)) = 'message' THEN lower(trim(role)) ELSE lower(trim(type)) END AS who,
    CASE WHEN regexp_matches(trim(timestamp), '^\d{11,14}$') THEN trim(timestamp)::BIGINT * 1000 ELSE epoch_us(try_cast(timestamp AS TIMESTAMPTZ)) END AS ats FROM session_events WHERE session_id IS NOT NULL ORDER BY event_id),
ok AS (SELECT *, coalesce(content, '') AS c, starts_with(coalesce(content, ''), '[{') AND NOT json_valid(content) AS broken FROM ev WHERE who IN ('user', 'assistant')),
txt AS (SELECT *, regexp_replace(CASE WHEN starts_with(c, '[{') AND NOT broken THEN coalesce(array_to_string(list_transform(list_filter(from_json(c, '["JSON"]'), lambda b: b->>'type' IN ('text', 'input_text', 'output_text')), lambda b: coalesce(b->>'text', '')), chr(10)), '') WHEN broken THEN '' ELSE c END, '^\s+|\s+$', '', 'g') AS shown FROM ok),
vis AS (SELECT *, regexp_extract(shown, '^<([A-Za-z_][\w.:-]*)[^<>]*>', 1) AS tag FROM txt),
msg AS (SELECT session_id, who, ats, c, min(event_id) AS event_id FROM vis WHERE shown <> '' AND NOT (tag <> '' AND ends_with(shown, '</' || tag || '>') AND strpos(shown, '</' || tag || '>') + length(tag) + 2 = length(shown)) GROUP BY 1, 2, 3, 4),
bad AS (SELECT session_id FROM ok WHERE broken UNION SELECT session_id FROM msg WHERE ats IS NULL),
pos AS (SELECT *, row_number() OVER w AS pos, lead(who) OVER w AS nxt FROM msg WHERE session_id NOT IN (SELECT session_id FROM bad) WINDOW w AS (PARTITION BY session_id ORDER BY ats, event_id)),
keep AS (SELECT session_id FROM pos GROUP BY 1 HAVING bool_and(CASE WHEN who = 'user' THEN coalesce(nxt = 'assistant', false) ELSE true END) AND min_by(who, pos) = 'user')
SELECT session_id, pos, event_id FROM pos WHERE session_id IN (SELECT session_id FROM keep)"""

_LIFTS = _PAIRS.replace("SELECT two.src, tag_a, tag_b FROM", "SELECT two.src, tag_a, tag_b, a.c AS n_a, b.c AS n_b, n_ab, n, round(n_ab * n / (a.c::DOUBLE * b.c), 6) AS lift, round(log2(n_ab * n / (a.c::DOUBLE * b.c)), 6) AS pmi FROM")

_SEGMENTS = r"""WITH ev AS (SELECT DISTINCT ON (event_id) event_id, ch, content, CASE WHEN lower(trim(type)) = 'message' THEN lower(trim(role)) ELSE lower(trim(type)) END AS who,
    CASE WHEN regexp_matches(trim(timestamp), '^\d{11,14}$') THEN trim(timestamp)::BIGINT * 1000 ELSE epoch_us(try_cast(timestamp AS TIMESTAMPTZ)) END AS ats
    FROM (SELECT *, max(coalesce('session ' || session_id, 'folder ' || cwd)) OVER (PARTITION BY event_id) AS ch FROM session_events) WHERE ch IS NOT NULL AND event_id IS NOT NULL ORDER BY event_id),
ok AS (SELECT *, coalesce(content, '') AS c, starts_with(coalesce(content, ''), '[{') AND NOT json_valid(content) AS broken FROM ev WHERE who IN ('user', 'assistant')),
txt AS (SELECT *, regexp_replace(CASE WHEN starts_with(c, '[{') AND NOT broken THEN coalesce(array_to_string(list_transform(list_filter(from_json(c, '["JSON"]'), lambda b: b->>'type' IN ('text', 'input_text', 'output_text')), lambda b: coalesce(b->>'text', '')), chr(10)), '') WHEN broken THEN '' ELSE c END, '^\s+|\s+$', '', 'g') AS shown FROM ok),
vis AS (SELECT *, regexp_extract(shown, '^<([A-Za-z_][\w.:-]*)[^<>]*>', 1) AS tag FROM txt),
msg AS (SELECT ch, who, coalesce(ats, -1) AS ats, c, broken OR ats IS NULL AS bad, min(event_id) AS event_id FROM vis WHERE broken OR shown <> '' AND NOT (tag <> '' AND ends_with(shown, '</' || tag || '>') AND strpos(shown, '</' || tag || '>') + length(tag) + 2 = length(shown)) GROUP BY 1, 2, 3, 4, 5),
gap AS (SELECT ats - lag(ats) OVER (PARTITION BY ch ORDER BY ats, event_id) AS g FROM msg WHERE ats >= 0),
hist AS (SELECT least(floor(4 * log2((g + 0.5) / 1e6))::INT, 119) AS b, count(*) AS n FROM gap WHERE g >= 1000000 GROUP BY 1),
bin AS (SELECT r.b, coalesce(n, 0) AS n FROM (SELECT unnest(range(120))::INT AS b) r LEFT JOIN hist ON hist.b = r.b),
smooth AS (SELECT b, coalesce(lag(n) OVER (ORDER BY b), 0) + 2 * n + coalesce(lead(n) OVER (ORDER BY b), 0) AS s FROM bin),
top AS (SELECT b AS t FROM smooth ORDER BY s DESC, b LIMIT 1),
mode AS (SELECT p.b, p.s, (SELECT min(s) FROM smooth v WHERE v.b > t AND v.b < p.b) AS low, t FROM smooth p, top WHERE p.b >= greatest(t + 2, 43)),
best AS (SELECT * FROM mode WHERE s > 0 AND 2 * (s - low) >= s ORDER BY s - low DESC, b LIMIT 1),
silence AS (SELECT greatest(1800, floor(pow(2, ((SELECT min(v.b) + max(v.b) FROM smooth v WHERE v.b > t AND v.b < best.b AND v.s = low) // 2) / 4.0))) * 1e6 AS us FROM best),
cut AS (SELECT *, CASE WHEN ats - lag(ats) OVER w > (SELECT us FROM silence) THEN 1 ELSE 0 END AS k FROM msg WINDOW w AS (PARTITION BY ch ORDER BY ats, event_id)),
seg AS (SELECT *, sum(k) OVER (PARTITION BY ch ORDER BY ats, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM cut),
pos AS (SELECT *, row_number() OVER w AS pos, lead(who) OVER w AS nxt FROM seg WINDOW w AS (PARTITION BY ch, segment ORDER BY ats, event_id)),
keep AS (SELECT ch, segment FROM pos GROUP BY 1, 2 HAVING NOT bool_or(bad) AND bool_and(CASE WHEN who = 'user' THEN coalesce(nxt = 'assistant', false) ELSE true END) AND min_by(who, pos) = 'user')
SELECT ch AS channel, segment::INT AS segment, pos, event_id, who AS speaker FROM pos JOIN keep USING (ch, segment) WHERE ch NOT IN (SELECT ch FROM msg WHERE ats < 0)"""

_OVER = f"""WITH {_CURRENT.replace("tags DESC NULLS LAST", "length(content) DESC NULLS LAST")} SELECT 'pages' AS src, path AS item_key FROM cur WHERE length(content) > 6000
UNION ALL SELECT DISTINCT 'chunks', chunk_id::VARCHAR FROM chunks WHERE abs(end_page - start_page) + 1 > 20 AND chunk_id IS NOT NULL"""

ORACLES = {"p2_found": _TALK, "p2_channels": _SEGMENTS, "p3_found": _PAIRS, "p3_pairs": _LIFTS, "p5_found": _OVER}
