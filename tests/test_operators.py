import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorebase.functions import frontmatter as M
from lorebase.functions import numbers as N
from lorebase.functions import text as X
from lorebase.operators import chunks as C
from lorebase.operators import graph as G
from lorebase.operators import ledgers as L
from lorebase.operators import rendering as R
from lorebase.operators import search as S
from lorebase.operators import usage as U
from lorebase.operators.components import components
from lorebase.operators.ranking import with_position


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expression.alias("r")).first()["r"]


def test_positions_in_a_group_that_holds_most_rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(20)}", rng.randrange(50), i) for i in range(2000)] + [(None, 1, 9001), (None, 1, 9000)]
    got = with_position(spark.createDataFrame(data, "g string, v int, id int"), ["g"], ["v", "id"]).collect()
    want = {}
    for g in {d[0] for d in data}:
        for p, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: d[1:]), 1):
            want[d[2]] = p
    assert {r["id"]: r["pos"] for r in got} == want


def test_positions_of_an_empty_table(spark):
    assert with_position(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).count() == 0


def test_components_of_chains_rings_and_stars(spark):
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("s0", f"s{i}") for i in range(1, 40)] + [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("x", "x"), (None, "y")]
    random.Random(1).shuffle(pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert {got[f"c{i:03}"] for i in range(71)} == {"c000"} and {got[f"s{i}"] for i in range(40)} == {"s0"} and {got[x] for x in ("r1", "r2", "r3")} == {"r1"}
    assert "x" not in got and "y" not in got and components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_slugs_keep_their_order_of_cut_and_strip(spark):
    assert one(spark, X.slug_short(F.col("t"), 5), t="abcd efgh") == "abcd"
    assert one(spark, X.slug_short(F.col("t"), 5, False), t="abcd efgh") == "abcd-"
    assert one(spark, X.slug_underscores(F.col("t")), t="Café au-lait!") == "café_au_lait_"
    assert one(spark, X.slug_words(F.col("t")), t=" A  b ") == "a--b"
    assert one(spark, X.slug_file(F.col("t")), t="What? A  Title -- here!") == "what-a-title-here.md"


def test_links_snippets_and_ids(spark):
    assert one(spark, X.wikilinks(F.col("t")), t="[[a|b]] x [[c#d]] [[e]]") == ["a", "c", "e"]
    assert one(spark, X.raw_wikilinks(F.col("t")), t="[[a|b]] [[_c]]") == ["a|b"]
    assert one(spark, X.snippet(F.col("t"), "NEEDLE", 5, 8), t="123456789\nneedle tail") == "6789 needle t"
    assert one(spark, X.canonical_id(F.col("t")), t="https://n/Tips-0123456789abcdef0123456789abcdef") == "01234567-89ab-cdef-0123-456789abcdef"
    assert one(spark, X.url_host(F.col("t")), t="https://www.a.example:80/x?y") == "a.example:80"
    assert one(spark, X.project_of_slug(F.col("t")), t="-home-workspace-play") == "play"
    assert one(spark, X.language_of(F.col("t")), t="a/b.tsx") == "TypeScript"
    assert X.fold_compatible(__import__("pandas").Series(["ﬁ \t x", None])).tolist()[0] == "fi x"


NOTE = '---\nwork: "Ship it"\ntags: [a, b]\nduration_min: 12\ncompacted: true\nempty: ~\n---\n\n## Position\n- **Status**: done: yes\n\n## Gotchas\nmind: the gap\n## Gotchas\nlast\n'


def test_front_matter_dialects(spark):
    f = M.note_fields(F.col("t"))
    assert one(spark, f["work"], t=NOTE) == "Ship it" and one(spark, M.note_list(f["tags"]), t=NOTE) == ["a", "b"]
    assert one(spark, M.note_number(f["duration_min"]), t=NOTE) == 12 and one(spark, M.note_flag(f["compacted"]), t=NOTE) is True and one(spark, f["empty"], t=NOTE) is None
    assert one(spark, M.index_tags(F.col("t")), t="---\ntags: [x-y, z]\n--- body") == ["x-y", "z"]
    assert one(spark, M.command_description(F.col("t")), t="---\nname: x\ndescription: Does it\n---") == "Does it"
    assert one(spark, f["work"], t="no front matter") is None
    row = R.session_notes(spark.createDataFrame([("n", NOTE), ("m", "nothing")], "path string, text string")).collect()
    assert len(row) == 1 and row[0]["status"] == "done: yes" and row[0]["gotchas"] == "last" and row[0]["duration_min"] == 12


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=30), st.sampled_from([0.5, 0.75, 0.9]))
def test_index_percentile(spark, values, share):
    got = spark.createDataFrame([(values,)], "v array<int>").select(N.index_percentile(F.col("v"), share).alias("r")).first()["r"]
    assert got == sorted(values)[int(len(values) * share)]


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 130), st.integers(1, 25))
def test_hard_split_covers_all_pages(spark, pages, most):
    got = C.hard_split(spark.createDataFrame([("d", pages)], "d string, p int"), "d", "p", most).orderBy("start_page").collect()
    assert [p for r in got for p in range(r["start_page"], r["end_page"] + 1)] == list(range(1, pages + 1))


def test_errors_gaps_and_buckets(spark):
    assert one(spark, U.error_class(F.col("t")), t="Permission edit") == "permission_denied" and one(spark, U.error_class(F.col("t")), t="?") == "other"
    rows = spark.createDataFrame([("s", x * 1_000_000) for x in (0, 1, 5, 9000, 9004)], "s string, at long")
    assert sorted(r["gap"] for r in U.gaps(rows, "s", "at").collect()) == [4.0, 4.0]


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(5)
    data = [(f"s{i:02}", a := rng.randrange(300), a + rng.randrange(120)) for i in range(60)]
    want = {(a[0], b[0]) for a in data for b in data if (b[1], b[0]) > (a[1], a[0]) and b[1] <= a[2]}
    got = U.overlaps(spark.createDataFrame(data, "id string, start long, stop long"), 50).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_ledger_status_and_merge(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, hash string")
    ledger = spark.createDataFrame([("a", "1"), ("b", "x")], "path string, hash string")
    assert {r["path"]: r["status"] for r in L.status(files, ledger).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert {(r["path"], r["hash"]) for r in L.merged(ledger, files.where("path = 'b'"), ["path"]).collect()} == {("a", "1"), ("b", "2")}


def test_semantic_edges_by_blocks_and_projection(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((80, 16))
    v[40:] = v[:40] + 0.1 * rng.standard_normal((40, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"v{i:02}", v[i].tolist()) for i in range(80)] + [("null", None)], "id string, vector array<double>")
    s = v @ v.T
    want = {(f"v{i:02}", f"v{j:02}") for i in range(80) for j in range(i + 1, 80) if s[i, j] >= 0.65}
    assert {(r["src"], r["dst"]) for r in G.semantic_edges(df, 0.65, blocks=5).collect()} == want
    near = {(r["src"], r["dst"]) for r in G.similar_by_projection(df, 0.65).collect()}
    assert near <= want and len(near) >= 0.9 * len(want)


def test_layout_of_few_and_equal_points(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 3.0, 1.0)], "id string, x double, y double")
    assert {(r["id"], r["x"], r["y"]) for r in G.scaled_layout(df).collect()} == {("a", -1000.0, 0.0), ("b", 1000.0, 0.0)}
    assert G.pca_layout(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vector array<double>")).count() == 2


def test_search_of_empty_tables_and_nulls(spark):
    schema = "path string, title string, tags string, summary string, updated string, content string, extra int"
    assert S.search(spark.createDataFrame([], schema), "x", "rag").count() == 0
    rows = spark.createDataFrame([("w/a.md", None, None, None, None, "an X here", 1), ("w/b.md", None, None, None, None, None, 2)], schema)
    assert [r["path"] for r in S.search(rows, "x").collect()] == ["w/a.md"]
    assert S.search(rows, "%").count() == 0 and S.search(rows, "%", wildcards=True).count() == 1


def test_rendering(spark):
    blocks = spark.createDataFrame([("p", 1, "heading_1", "T", None), ("p", 2, "code", "x", "py"), ("p", 3, "odd", "?", None), ("p", 4, "divider", None, None)], "page string, pos int, type string, text string, language string")
    assert R.blocks_markdown(blocks).first()["markdown"] == "# T\n\n```py\nx\n```\n\n---"
    pages = spark.createDataFrame([("a", "body")], "id string, content string")
    twice = R.with_link(R.with_link(pages, "a", "b"), "a", "b").first()["content"]
    assert twice == "body\n\n## See Also\n- [[b]]\n"
    files = R.fenced_files(spark.createDataFrame([(1, "x\n```md\n---\nname: my cmd\n---\nbody\n```\n")], "k int, t string"), "k", "t").first()
    assert files["file"] == "my_cmd.md"
    vectors = R.embedded(pages, "content", lambda: (lambda texts: [[3.0, 4.0] for _ in texts])).first()["vector"]
    assert [round(x, 3) for x in vectors] == [0.6, 0.8]
    assert R.mapped(pages, "content", lambda: (lambda texts: [t.upper() for t in texts])).first()["reply"] == "BODY"
    notes = C.fold_chunks(spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "d string, n int, t string"), "d", "n", "t", lambda prev, t: prev + t).first()["notes"]
    assert notes == ["a", "ab"]


def test_graph_invariants(spark, folder):
    from lorebase.plans.graph import nodes

    n = nodes(spark, folder)
    e = G.tag_edges(n)
    assert e.where("src = dst").count() == 0
    assert e.join(n.select(F.col("id").alias("src")), "src", "left_anti").count() == 0
    assert e.join(n.select(F.col("id").alias("dst")), "dst", "left_anti").count() == 0
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_the_columns_needed(spark, folder):
    plan = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id > 5").select("doc_id", "lang")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan and "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan


@pytest.mark.parametrize("text,want", [("Relevance: 5/5 #Ab #ab #c-d", (5, ["ab", "c-d"])), ("none", (3, [])), ("Relevance: 9/5", (5, []))])
def test_relevance_and_tags(spark, text, want):
    assert (one(spark, X.relevance_of(F.col("t")), t=text), one(spark, X.inline_tags(F.col("t")), t=text)) == want
