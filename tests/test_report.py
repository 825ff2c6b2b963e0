"""Operators of the report, of prompts and of lookups on small tables with nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from lorebase.functions import text as X
from lorebase.operators import graph as G
from lorebase.operators import prompts as P
from lorebase.operators import report as R
from lorebase.operators import search as S
from lorebase.operators import vectors as V


def brute(sessions):
    pairs = [(a, b) for a in sessions for b in sessions if (b[1], b[0]) > (a[1], a[0]) and b[1] <= a[2]]
    ids = {s[0] for p in pairs for s in p}
    some, every = sum(s[3] for s in sessions if s[0] in ids), sum(s[3] for s in sessions)
    return len(pairs), len(ids), some, round(some * 100 / every) if every else 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_parallel_sessions_equal_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(f"s{i:02}", t, t + rng.choice([0, 0, 3, 10, 40]), rng.randint(0, 9)) for i in range(60) for t in [rng.randint(0, 300)]]
    got = R.parallel_sessions(spark.createDataFrame(rows, "id string, start long, stop long, messages long")).first()
    assert (got["overlap_events"], got["sessions_involved"], got["overlap_messages"], got["pct_messages"]) == brute(rows)


def test_parallel_sessions_of_nothing_and_of_one_hot_span(spark):
    schema = "id string, start long, stop long, messages long"
    assert tuple(R.parallel_sessions(spark.createDataFrame([], schema)).first()) == (0, 0, 0, 0)
    rows = [(f"s{i}", 5, 5, 1) for i in range(300)]
    assert R.parallel_sessions(spark.createDataFrame(rows, schema)).first()["overlap_events"] == 300 * 299 // 2


def test_frequencies_and_mean(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4), ("a", 5), (None, 0)], "k string, at int")
    assert [tuple(r) for r in R.frequencies(rows, "k", "at", 2).collect()] == [("b", 2), ("a", 2)]
    gaps = spark.createDataFrame([(1.0,), (2.5,)], "gap double")
    assert R.mean_response(gaps).first()[0] == 1.8 and R.mean_response(gaps.limit(0)).first()[0] == 0.0


def test_tool_prompts(spark):
    long = "please look at the failing retriever"
    block = lambda t: f'[{{"type": "input_text", "text": "{t}"}}]'
    rows = [(1, "message", "user", block("# Context from my IDE setup:\\n## Open tabs\\n" + long)), (2, "message", "user", block("<environment_context> and much more text")), (3, "message", "user", block("short")), (4, "message", "assistant", block(long)), (5, "user", None, long), (6, "message", "user", '[{"type": "output_text", "text": "x"}, {"type": "input_text", "text": "   "}, {"type": "input_text", "text": "' + long + '"}]'), (7, "message", "user", None), (8, "message", "user", "[{broken"), (9, "message", "user", block(long * 20))]
    got = {r["event_id"]: r["prompt"] for r in P.tool_prompts(spark.createDataFrame([(*r, "s") for r in rows], "event_id long, type string, role string, content string, session_id string")).collect()}
    assert set(got) == {1, 6, 9} and got[1] == got[6] == long and len(got[9]) == 300


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert one(X.checklist(F.array(F.lit("a"), F.lit("b")))) == "- [ ] a\n- [ ] b" and one(X.checklist(F.array().cast("array<string>"))) == "- [ ] None detected"
    assert one(X.url_quoted(F.lit("a b/c~d*é+&"))) == "a%20b/c~d%2A%C3%A9%2B%26" and one(X.thousands(F.lit(1234567))) == "1,234,567"
    for text, want in (("```json\n{\"a\": 1}\n```\nmore", '{"a": 1}'), ("  plain ", "plain"), ("```", ""), ("```x", "")):
        assert one(X.unfenced(F.lit(text))) == want
    assert one(R.percent(F.lit(0.125))) == "12%"


def test_reply_fields(spark):
    rows = spark.createDataFrame([(1, '```json\n{"kind": "a"}\n```'), (2, '{"kind": "z"}'), (3, "nonsense"), (4, None), (5, '{"kind": "b", "other": 1}'), (6, "{}")], "id int, reply string")
    got = {r["id"]: r["k"]["kind"] if r["k"] else None for r in rows.select("id", P.reply_fields(F.col("reply"), {"kind": ("a", "b")}).alias("k")).collect()}
    assert got == {1: "a", 2: None, 3: None, 4: None, 5: "b", 6: None}


def test_reranked_degrades(spark):
    docs = spark.createDataFrame([("q", f"d{i}", i) for i in range(4)] + [("r", "d0", 0), ("r", "d1", 1)], "q string, d string, place int")
    ranks = spark.createDataFrame([("q", "d2", 1, 0.9), ("q", "d0", 2, 0.7), ("q", "d0", 3, 0.1), ("q", "gone", 1, 1.0), ("r", "d1", None, 0.4)], "q string, d string, rank int, score double")
    got = [tuple(r) for r in P.reranked(docs, ranks, "q", "d", "place").orderBy("q", "position").collect()]
    assert got == [("q", "d2", 1, 0.9), ("q", "d0", 2, 0.7), ("q", "d1", 3, 0.5), ("q", "d3", 4, 0.5), ("r", "d0", 1, 0.5), ("r", "d1", 2, 0.5)]


def test_page_by_id_and_dashboard(spark):
    pages = spark.createDataFrame([("wiki/b/one.md", "First", "Rag eval", "s", "body"), ("wiki/a/_two.md", "my page", None, None, "hidden"), ("wiki/c/x.md", "My Page", "", None, None), ("wiki/b/y.md", "my page", None, None, "later")], "path string, title string, tags string, summary string, content string")
    assert [tuple(r) for r in S.page_by_id(pages, "one").collect()] == [(1, "wiki/b/one.md", "# First\n\nSummary: s\n\nbody")]
    assert S.page_by_id(pages, "My-page").first()["path"] == "wiki/b/y.md" and S.page_by_id(pages, "none").count() == 0
    assert [r["path"] for r in S.dashboard_search(pages, "EVAL").collect()] == ["wiki/b/one.md"] and S.dashboard_search(pages, "Rag").count() == 0
    assert S.selected(pages).count() == 4 and S.selected(pages, ("eval",)).count() == 1 and S.selected(pages, (), ("decision",)).count() == 0


def test_title_graph(spark):
    pages = spark.createDataFrame([("a/x.md", "X", "[[Y]] [[Y|again]] [[X]] [[Gone]]"), ("a/y.md", None, None), ("b/y2.md", "Y", "[[X#part]]")], "path string, title string, content string")
    nodes, edges = G.title_graph(pages)
    assert {tuple(r) for r in edges.collect()} == {("X", "Y"), ("Y", "X")}
    assert {r["title"]: (r["degree"], r["size"]) for r in nodes.collect()} == {"X": (5, 50), "Y": (3, 40), "y": (0, 25)}
    styled = G.styled(spark.createDataFrame([("rag", "concept"), (None, "x")], "domain string, type_tag string"), {"rag": "#111111"}, {})
    assert {(r["colour"], r["shape"]) for r in styled.collect()} == {("#111111", "ellipse"), ("#9E9E9E", "ellipse")}


def test_conflicts_stale_best(spark):
    pages = spark.createDataFrame([("a", "x\n**Status:** Unresolved — y\n**Status:** Unresolved", "2026/01/05"), ("b", "**Status:** Resolved", "2026-13-01"), ("c", None, "soon"), ("d", "", None)], "path string, content string, updated string")
    assert [tuple(r) for r in G.conflicts(pages).collect()] == [("a", 2)] and [tuple(r) for r in G.stale(pages, "2026-10-01").collect()] == [("a", "2026-01-05")]
    rows = spark.createDataFrame([(1, "h", None), (2, "h", 5), (3, "h", 5), (4, "g", None)], "id long, h string, q int")
    assert {tuple(r) for r in V.best_per(rows, F.col("h"), "q", "id").collect()} == {(2, 3), (4, 1)}


def test_merge_prompts_are_bounded(spark):
    rows = spark.createDataFrame([("s", i, f"n{i}") for i in range(50)] + [("t", 1, None)], "src string, at int, text string")
    got = P.merge_prompts(rows, "src", "at", "text", 3).collect()
    assert [tuple(r) for r in got] == [("s", "### Note 1\nn0\n\n### Note 2\nn1\n\n### Note 3\nn2", 47)]


def test_upsert_survives_a_cut(spark, tmp_path):
    import os

    from lorebase.sources import sinks

    path = f"{tmp_path}/t"
    sinks.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    os.rename(path, path + ".old")  # a run that ended between the two renames
    sinks.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, ["k"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (3, "d")} and os.listdir(tmp_path) == ["t"]


def test_files_keep_their_folders(spark, tmp_path):
    from lorebase.sources import sinks

    rows = spark.createDataFrame([("a/b/x.md", "one"), ("../out.md", "two"), ("y.md", None), (None, "z")], "name string, markdown string")
    got = {r["name"]: r["state"] for r in sinks.write_texts(rows, f"{tmp_path}/d").collect()}
    assert got == {"a/b/x.md": "written", "../out.md": "refused", "y.md": "written"} and (tmp_path / "d/a/b/x.md").read_text() == "one"
    captures = spark.createDataFrame([("---\nurl_hash: " + spark.range(1).select(sinks.url_hash(F.lit("https://a.example"))).first()[0] + "\n---\nx",), ("no front matter",)], "text string")
    assert [r["url"] for r in sinks.captured(spark.createDataFrame([("https://a.example",), ("https://b.example",)], "url string"), captures).collect()] == ["https://b.example"]


def test_silences_and_segments_of_a_hot_group(spark):
    from lorebase.operators import usage as U

    rows = [("hot", i * 1_000_000 + (i // 500) * 10_000_000_000) for i in range(3000)] + [("cold", 5), ("cold", None), (None, 7)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, at long, id long")
    assert U.gaps(df, "g", "at", 0.5, 2.0).count() == 3000 - 6
    got = {(r["g"], r["session"]): r["events"] for r in U.sessions_by_silence(df.where("g IS NOT NULL"), "g", "at", "id", 5_000_000).collect()}
    assert got == {**{("hot", k): 500 for k in range(1, 7)}, ("cold", 1): 1}


def test_roots_depth_types_and_trees(spark, tmp_path):
    from lorebase.sources import files, html

    for name in ("a/one.jsonl", "a/b/two.jsonl", "three.jsonl"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text('{"type": "user"}\nnot json\n')
    found = lambda **k: sorted(r["session_id"] for r in files.session_lines(spark, [f"{tmp_path}/r", f"{tmp_path}/missing"], **k).collect())
    assert found() == ["one", "three", "two"] and found(depth=1) == ["one"] and files.session_lines(spark, [f"{tmp_path}/none"]).count() == 0
    (tmp_path / "r/README.md").write_text("\n".join(f"l{i}" for i in range(200)))
    tree = files.code_tree(f"{tmp_path}/r", 2, 3).split("\n")
    assert tree == ["r/", "  [dir] a", "  README.md", "", "--- README ---", "l0", "l1", "l2"]
    pages = spark.createDataFrame([("https://a.example", "<p>text that is long enough</p>", "Text/HTML; charset=utf-8"), ("https://b.example", "x", "application/pdf"), ("https://c.example", "x", None)], "url string, html string, content_type string")
    assert [r["url"] for r in html.captures(pages, "2026-01-01").collect()] == ["https://a.example"]
    text = spark.createDataFrame([("x.pdf", 12, "late"), ("x.pdf", 2, "b"), ("x.pdf", 1, "a"), ("y.pdf", 11, "z")], "path string, page int, text string")
    assert [tuple(r) for r in files.page_range(text).collect()] == [("x.pdf", "a\fb")] and {tuple(r) for r in files.page_counts(text).collect()} == {("x.pdf", 12), ("y.pdf", 11)}
