import duckdb
import pytest

from lorebase.plans.catalogue import ORACLES, QUERIES
from tests.oracles import rows, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    df = QUERIES[name](spark, folder).toPandas()
    columns, want = sql_rows(ORACLES[name], folder)
    assert sorted(df.columns) == columns
    assert rows(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["path", "title", "tags", "summary", "snippet"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_links_of_pages_are_found(spark, tmp_path):
    rows = [
        ("wiki/a/one.md", "Decision 1: One", "2026-01-02", "See [[ two ways|x]], [[DECISION 3: Late#part]], [[Nowhere]], [[decision 1: one]] and [[Gone]]"),
        ("wiki/a/one.md", "Decision 1: One", "2026-01-01", "an old state with [[Old]]"),
        ("wiki/b/two-ways.md", None, None, "[[One]] [[ ]] [[nowhere|y]]"),
        ("wiki/b/late.md", "Decision 3: Late", None, None),
        ("wiki/c/late.md", "decision 3: late ", None, ""),
        (None, "Gone", None, "[[One]]"),
    ]
    spark.createDataFrame([(p, t, "", "", u, c) for p, t, u, c in rows], "path string, title string, tags string, summary string, updated string, content string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {n: {(r["src"], r["dst"]) for r in QUERIES[n](spark, str(tmp_path)).collect()} for n in ("page_links", "page_dead_links")}
    assert got["page_links"] == {("wiki/a/one.md", d) for d in ("wiki/b/two-ways.md", "wiki/b/late.md", "wiki/c/late.md")} | {("wiki/b/two-ways.md", "wiki/a/one.md")}
    assert got["page_dead_links"] == {("wiki/a/one.md", "Nowhere"), ("wiki/a/one.md", "Gone"), ("wiki/b/two-ways.md", "nowhere")}


def test_merge_and_focus_leave_no_key_out(spark, folder):
    from lorebase.plans.catalogue import table

    assert QUERIES["label_merge"](spark, folder).select("doc_id").distinct().count() == table(spark, folder, "documents").count()
    orders = table(spark, folder, "orders")
    least = orders.agg({"o_custkey": "min"}).first()[0]
    got = {r["id"] for r in QUERIES["order_focus"](spark, folder).collect()}
    assert {f"o{r['o_orderkey']}" for r in orders.where(f"o_custkey = {least}").collect()} == {i for i in got if i[0] == "o"} and any(i[0] == "s" for i in got)


@pytest.fixture
def hot_nodes(spark, tmp_path):
    """Nodes of which most have one tag, with repeated rows and missing folders: 26,000 pairs and more."""
    tags = lambda i: ["rag"] * (i % 9 > 0) + ["mcp", "eval"] * (i % 7 == 0) + ["bm25"] * (i % 50 == 0) + [None, "other"] * (i % 3 == 0)
    folder = lambda i: None if i % 41 == 0 else ["rag"] if i % 4 else ["mcp" if i % 8 else f"f{i % 10}"]
    rows = [(f"n{i:03}", (tags(i) or None, folder(i))) for i in [*range(400), 3, 49, 350]]
    spark.createDataFrame(rows, "id string, data struct<tags: array<string>, domain: array<string>>").write.parquet(f"{tmp_path}/nodes.parquet")
    return str(tmp_path)


def shuffled(spark, df):
    """(rows of ``df``, records that all its stages wrote to shuffles)."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    return df().toPandas(), written() - before


def hot_equals_sql(spark, folder, name):
    (con := duckdb.connect()).execute(f"CREATE VIEW nodes AS SELECT * FROM '{folder}/nodes.parquet/*.parquet'")
    want = rows(con.execute(ORACLES[name]).fetchdf())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for large tables
    try:
        got, records = shuffled(spark, lambda: QUERIES[name](spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert rows(got) == want
    return len(want), records


def test_degrees_are_counted_without_pairs(spark, hot_nodes):
    nodes, records = hot_equals_sql(spark, hot_nodes, "node_degree")
    assert nodes == 400 and records < 4000


def test_visibility_shuffles_no_pairs(spark, hot_nodes, monkeypatch):
    monkeypatch.setattr("lorebase.operators.graph.BLOCK", 60)
    pairs, records = hot_equals_sql(spark, hot_nodes, "edge_visibility")
    assert pairs > 20_000 and records < 10_000


def test_shared_tags_shuffle_no_pairs(spark, hot_nodes, monkeypatch):
    monkeypatch.setattr("lorebase.operators.graph.BLOCK", 60)
    pairs, records = hot_equals_sql(spark, hot_nodes, "tag_shared_edges")
    assert pairs > 20_000 and records < 10_000


def test_tag_edges_of_ids_in_several_folders(spark, monkeypatch):
    from lorebase.operators import graph as G

    monkeypatch.setattr(G, "BLOCK", 5)
    rows = [(f"n{i % 23}", ["a", "b", "c"][i * i % 3 if i % 5 else 2], [t for k, t in enumerate(("rag", "mcp", "eval")) if i * 7 % (k + 3) == 0]) for i in range(60)]
    want = {}
    for x, d, s in rows:
        for y, e, t in rows:
            if x < y and d != e and set(s) & set(t):
                want.setdefault((x, y), set()).update(set(s) & set(t))
    got = G.tag_edges(spark.createDataFrame(rows, "id string, domain string, tags array<string>")).collect()
    assert sorted((r["src"], r["dst"], r["shared_tags"]) for r in got) == sorted((x, y, sorted(s)) for (x, y), s in want.items())
