import os
import random

import pytest

from lorebase.llm import mixing as X
from lorebase.llm import tokenizing as T

PATH = f"{T.FOLDER}/{T.TOKENIZER}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")

TEXTS = ["", None, " ", "Hello  world!\r\n\r\n\t x", "<|endoftext|> and <|startoftext|>", "naïve café 漢字かな🙂👩‍🔬", "²½ Ⅷ _x_ 12345678901", "a" * 5000, "\u0000�​", "don't we'll I'VE", "ab" * 3000 + "\n" * 700, "𝔘𝔫𝔦 ﬁ"]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_library(spark):
    rng = random.Random(0)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x400, 0x500), 0x1F600 + rng.randrange(60), 10])) for _ in range(rng.randrange(300))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in T.encode(df).collect()}
    assert [got[i] for i in range(len(texts))] == library(texts)


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(T, "WORDS_KEPT", 5)
    monkeypatch.setattr(T, "ROWS_AT_ONCE", 20)
    e = T.Encoder(PATH)
    texts = ["one two three four", "five six seven eight nine", "one two ten"]
    for t, want in zip(texts, library(texts)):
        assert e.encode([t])[0].tolist() == want


def test_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = [x for x in TEXTS if x]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in T.encode(df).collect():
        assert t.decode(r["ids"], skip_special_tokens=False) == texts[r["doc_id"]]


def test_empty_table(spark):
    assert T.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def documents(spark, rows):
    return spark.createDataFrame([(i, s, t, 7) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string, n_tokens int")


def test_shares_are_met_within_the_caps(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["Big", "big ", "BIG"]), "word " * rng.randrange(1, 60)) for _ in range(3000)] + [("small", "word " * rng.randrange(1, 30)) for _ in range(150)] + [("other", "x y z"), (None, "no source"), ("big", None), ("big", ""), ("unlisted", "text")]
    targets = spark.createDataFrame([("big", 6.0, 1, None), ("Small", 3.0, 3, "n"), ("missing", 1.0, 2, None), ("other", 0.0, 1, None), (None, 5.0, 1, None), ("small", None, 3, None), ("big", float("nan"), None, None)], "source string, weight double, max_repeats int, note string")
    sizes = X.sized_documents(documents(spark, rows))
    plan = X.plan_mixture(sizes, targets)
    mixed = X.mixture(sizes, plan).cache()
    got = {r["source"]: r for r in X.shares(mixed, plan).collect()}
    assert abs(got["big"]["share"] - 6 / 9) < 0.02 and abs(got["small"]["share"] - 3 / 9) < 0.02
    assert got["small"]["most_copies"] <= 3 and got["big"]["most_copies"] <= 1 and got["missing"]["state"] == "no documents" and got["other"]["mixed_docs"] == 0
    assert mixed.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    full = X.plan_mixture(sizes, targets, total=10**9)
    assert {r["source"]: r["state"] for r in X.shares(X.mixture(sizes, full), full).collect()}["big"] == "at its cap"
    assert {r["source"]: r["most_copies"] for r in X.shares(X.mixture(sizes, full), full).collect()}["small"] == 3


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1, "")], "source string, weight double, max_repeats int, note string")
    sizes = X.sized_documents(documents(spark, [("a", "x")]).limit(0))
    plan = X.plan_mixture(sizes, targets)
    assert X.mixture(sizes, plan).count() == 0 and X.shares(X.mixture(sizes, plan), plan).count() == 1
    assert X.plan_mixture(sizes, targets.limit(0)).count() == 0


def test_a_small_source_does_not_shrink_the_mixture(spark, tmp_path):
    from lorebase.llm.queries import QUERIES

    rows = [("big", "word " * 50)] * 400 + [("middle", "word " * 50)] * 100 + [("tiny", "word " * 5)] * 2
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    targets = [("big", 1.0, 1, ""), ("middle", 1.0, 4, ""), ("tiny", 1.0, 3, ""), ("none", 1.0, 1, "")]
    spark.createDataFrame(targets, "source string, weight double, max_repeats int, note string").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {r["source"]: r for r in QUERIES["p7_shares"](spark, str(tmp_path)).collect()}
    assert 160 <= got["big"]["mixed_docs"] <= 173 and got["big"]["short_by"] == 0 and got["big"]["state"] == "goal reached"
    assert got["middle"]["mixed_docs"] == 100 and got["middle"]["most_copies"] == 2 and got["middle"]["short_by"] == 0
    assert got["tiny"]["most_copies"] == 3 and got["tiny"]["state"] == "at its cap" and got["tiny"]["short_by"] > 0.2
    assert got["none"]["short_by"] == 0.25


def test_state_goes_by_what_is_in_the_mixture(spark):
    sizes = spark.createDataFrame([(i, "big", 10) for i in range(1000)] + [(5000 + i, "small", 7) for i in range(10)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 1.0, 1, ""), ("small", 1.0, 3, ""), ("absent", 2.0, 9, ""), ("barred", 1.0, 0, "")], "source string, weight double, max_repeats int, note string")
    plan = X.plan_mixture(sizes, targets, total=400)
    got = {r["source"]: r for r in X.shares(X.mixture(sizes, plan), plan).collect()}
    assert abs(got["big"]["mixed_tokens"] - 200) < 10 and got["big"]["state"] == got["small"]["state"] == "goal reached" and got["big"]["aim_share"] == 0.5 and got["big"]["target_share"] == 0.2
    assert got["absent"]["state"] == "no documents" and got["barred"]["state"] == "no weight" and got["absent"]["short_by"] == 0.4
    plan = X.plan_mixture(sizes, targets, total=4000)
    got = {r["source"]: r for r in X.shares(X.mixture(sizes, plan), plan).collect()}
    assert got["small"]["state"] == "at its cap" and got["small"]["mixed_tokens"] == 210 and got["big"]["state"] == "goal reached"
    lost = X.mixture(sizes, plan).where("doc_id > 400")
    assert {r["source"]: r["state"] for r in X.shares(lost, plan).collect()}["big"] == "missed"


def test_only_documents_that_can_be_used_are_counted(spark):
    docs = spark.createDataFrame([(1, " A ", "one two"), (2, "b", "x"), (3, None, "y"), (4, "a", None)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1, ""), ("b", 0.0, 1, "")], "source string, weight double, max_repeats int, note string")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in X.sized_documents(docs, targets).collect()) == [(1, 2), (4, 0)]


@pytest.mark.parametrize("word", ["abcdefghij" * 3000, "".join(chr(97 + i * i * 7 % 26) for i in range(60_000)), "ACGTTGCA" * 4000, "a" * 50_001, "é" * 20_000 + "日本" * 3000, "QxZqJv" * 5000])
def test_long_words_take_no_longer_than_others(word):
    import time

    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(f"{T.FOLDER}/{T.TOKENIZER}")
    encoder = T.Encoder(f"{T.FOLDER}/{T.TOKENIZER}")
    began = time.process_time()
    ids, ends = encoder.encode([word, "a b", None, ""])
    assert time.process_time() - began < 20
    assert ids[: ends[1]].tolist() == exact.encode(word, add_special_tokens=False).ids and ends.tolist()[2:] == [ends[2]] * 3
