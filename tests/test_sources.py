import json
import os
import time

from pyspark.sql import functions as F

from lorebase.sources import files, html, sinks
from lorebase.streaming import watch


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def page(title, tags, body=""):
    return f"---\ntitle: {title}\ntags: [{tags}]\nsummary: s\nupdated: 2026-01-01\n---\n{body}"


def test_markdown_trees(spark, tmp_path):
    root = str(tmp_path / "wiki")
    put(f"{root}/rag/a b.md", page("A", "rag", "[[c]]"))
    put(f"{root}/_index.md", "index")
    put(f"{root}/mcp/c.md", b"bad \xff byte")
    put(f"{root}/mcp/.hidden.md", "no")
    assert {(r["path"], r["text"]) for r in files.markdown(spark, root).where("path LIKE 'mcp%'").collect()} == {("mcp/c.md", "bad  byte")}
    assert {r["path"] for r in files.markdown(spark, root).collect()} == {"rag/a b.md", "mcp/c.md"}
    assert {r["path"] for r in files.markdown_with_hidden(spark, root).collect()} == {"rag/a b.md", "mcp/c.md", "_index.md"}
    assert {r["path"] for r in files.harvest(spark, root, ("rag", "mcp"), ("mcp",)).collect()} == {"rag/a b.md"}


def test_ledgers_and_sessions(spark, tmp_path):
    put(str(tmp_path / "m.jsonl"), '{"path":"a","hash":"1"}\n\nnot json\n{"path":"a","hash":"2","wiki_pages":["x"]}\n{"path":"b","hash":"3"}\n')
    assert {(r["path"], r["hash"]) for r in files.json_ledger(spark, str(tmp_path / "m.jsonl")).collect()} == {("a", "2"), ("b", "3")}
    put(str(tmp_path / "p.json"), json.dumps({"k": {"date": "d", "hash": "h"}}))
    assert files.object_ledger(spark, str(tmp_path / "p.json")).first()["hash"] == "h"
    root = str(tmp_path / "proj")
    put(f"{root}/s1.jsonl", "\n".join(json.dumps(x) for x in [{"id": "s1", "timestamp": "2026-01-02T00:00:00Z", "git": {"branch": "main", "repository_url": "git@x:a/repo.git"}}, {"type": "user", "cwd": "/w", "timestamp": "2026-01-02T00:00:01Z", "message": {"role": "user", "content": "hello"}}, {"type": "assistant", "message": {"role": "assistant", "model": "m", "content": [{"type": "text", "text": "hi"}], "usage": {"input_tokens": 5}}}]) + "\nbroken{\n")
    put(f"{root}/subagents/s2.jsonl", '{"type":"user"}\n')
    lines = files.session_lines(spark, [root])
    events = files.session_events(lines).orderBy("line_no").collect()
    assert len(events) == 3 and events[1]["content"] == "hello" and events[2]["usage"]["input_tokens"] == 5 and json.loads(events[2]["content"])[0]["text"] == "hi"
    assert files.first_line_meta(lines).first()["repo"] == "repo"
    put(str(tmp_path / "facets/x.json"), '{"outcome": "done"}')
    assert files.keyed_json(spark, str(tmp_path / "facets"), "session_id string, outcome string").first()["session_id"] == "x"
    put(str(tmp_path / "b.txt"), "# c\nhttps://a.example/x \n\n http://no\n")
    assert [r["url"] for r in files.bookmarks(spark, str(tmp_path / "b.txt")).collect()] == ["https://a.example/x"]
    put(str(tmp_path / "pdf/a.pdf"), b"%PDF-1.4 x")
    assert files.binaries(spark, str(tmp_path / "pdf")).first()["length"] == 10


def test_html(spark):
    text = "<html><head><title> T &amp; x </title></head><body><nav><p>a navigation text that is long</p></nav><article><h2>A heading that is long enough</h2><p>First paragraph of sufficient length<p>Second one, not closed, also long<ul><li>short</li></ul><pre>code block of some length</pre></article></body></html>"
    title, body = html.extract(text)
    assert title == "T & x" and body.split("\n\n") == ["## A heading that is long enough", "First paragraph of sufficient length", "Second one, not closed, also long", "```\ncode block of some length\n```"]
    row = html.captures(spark.createDataFrame([("https://www.a.example/p", text), ("https://b.example", None)], "url string, html string"), "2026-01-01").orderBy("url").collect()
    assert row[0]["domain"] == "b.example" and row[1]["markdown"].startswith("---\ntitle: T & x\n")


def fetch_twice(resource, cursor):
    return ([{"id": f"{resource}{cursor or 0}"}], None if cursor else 1)


def test_paged_source(spark):
    from lorebase.sources.rest import PagedReader

    reader = PagedReader({"fetch": "tests.test_sources:fetch_twice", "path": "a,b"})
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == ["a0", "a1", "b0", "b1"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "1"), ("b.md", "2")], "name string, markdown string")
    out = str(tmp_path / "out")
    assert {r["state"] for r in sinks.write_texts(rows, out).collect()} == {"written"}
    assert {r["state"] for r in sinks.write_texts(rows, out).collect()} == {"kept"}
    assert sinks.missing(rows.union(spark.createDataFrame([("c.md", "3")], rows.schema)), out).first()["name"] == "c.md"
    table = str(tmp_path / "t")
    sinks.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), table, ["k"])
    sinks.upsert(spark.createDataFrame([(2, "c")], "k int, v string"), table, ["k"])
    assert {tuple(r) for r in spark.read.parquet(table).collect()} == {(1, "a"), (2, "c")}
    sinks.write_report(spark, str(tmp_path / "rep"), "2026-01-01", "04:00", "text", {"n": 1})
    assert json.load(open(tmp_path / "rep/latest.json"))["n"] == 1


def test_watch_sees_edits_and_deletions(spark, tmp_path):
    root, seen = str(tmp_path / "wiki"), []
    put(f"{root}/rag/a.md", page("A", "rag, mcp", "[[b]]"))
    put(f"{root}/mcp/b.md", page("B", "mcp"))
    query = watch.watch(spark, root, str(tmp_path / "check"), lambda n, e: seen.append((n.count(), e.count())), {"processingTime": "500 milliseconds"})
    try:
        wait = lambda n: [time.sleep(0.3) for _ in range(60) if len(seen) < n]
        wait(1)
        assert seen[0] == (2, 2)
        put(f"{root}/mcp/b.md", page("B", "voice"))
        wait(2)
        assert seen[1] == (2, 1)
        os.remove(f"{root}/rag/a.md")
        wait(3)
        assert seen[2] == (1, 0)
    finally:
        query.stop()


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("2026-01-01 00:10:00", "view", 1.0, 1), ("2026-01-01 00:20:00", "view", 2.0, 1), ("2026-01-01 05:00:00", "click", 1.0, 1)], "ts string, event_type string, value double, user_id int").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double, user_id int").parquet(src)
    q = watch.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["event_type"], r["n"], r["total"]) for r in spark.table("counts").collect()} == {("view", 2, 3.0), ("click", 1, 1.0)}
