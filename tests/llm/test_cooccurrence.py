import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lorebase.llm.cooccurrence import tag_records, together


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    tags = [f"t{i}" for i in range(25)]
    rows = [("x", str(i), rng.sample(tags, rng.randrange(6)) + (["a", "b"] if rng.random() < 0.2 else [])) for i in range(400)] + [("x", "n", None), ("y", "e", [])]
    rows = [(s, k, None if t is None else [*t, t[0].upper() if t else None, "  "]) for s, k, t in rows]
    got = {(r["src"], r["item_a"], r["item_b"]): r for r in together(spark.createDataFrame(rows, "src string, key string, items array<string>"), 3, 0.002, 1.2).collect()}
    base = [{t.lower() for t in items or [] if t and t.strip()} for s, _, items in rows if s == "x"]
    n, one, two = len(base), Counter(t for b in base for t in b), Counter((a, b) for s in base for a in s for b in s if a < b)
    want = {("x", a, b) for (a, b), k in two.items() if k >= 3 and k >= 0.002 * n and k * n * 10 >= 12 * one[a] * one[b]}
    assert set(got) == want and ("x", "a", "b") in want
    r = got["x", "a", "b"]
    assert (r["n"], r["n_ab"]) == (n, two["a", "b"]) and math.isclose(r["pmi"], math.log2(r["n_ab"] * n / (one["a"] * one["b"])))


def test_records_take_the_current_row_and_respelled_tags(spark):
    pages = spark.createDataFrame([("p", "old", "2026-1-5", "c", 1), ("p", "#Rag, hybrid_search , RAG,", "2026/02/01", "c", 1), ("q", None, None, None, 2), (None, "x", None, None, 3)], "path string, tags string, updated string, content string, key int")
    node = "id string, data struct<tags:array<string>>, src string"
    nodes = spark.createDataFrame([("n", (["A_b", None, ""],), "clash"), ("n", (["a-b"],), "clash"), ("m", (None,), "clash"), ("k", None, "clash")], node)
    from lorebase.llm.cooccurrence import cleaned

    got = {(r["src"], r["key"]): r["items"] for r in tag_records(pages, nodes).select("src", "key", cleaned(F.col("items")).alias("items")).collect()}
    assert got == {("pages", "p"): ["hybrid-search", "rag"], ("pages", "q"): [], ("nodes", "n"): ["a-b"], ("nodes", "m"): [], ("nodes", "k"): []}
    assert together(tag_records(pages.limit(0), nodes.limit(0))).count() == 0
