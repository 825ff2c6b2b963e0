import random
import re

import numpy as np
import pytest

from lorebase.llm import near_duplicates as N


def texts(n_families=14, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    out = {}
    for f in range(n_families):
        base = rng.choices(words, k=rng.choice([8, 20, 45, 90, 140, 260, 600]))
        for v in range(4):
            t = list(base)
            for _ in range(int(len(t) * 0.02 * v * v) + v):
                i = rng.randrange(len(t))
                rng.choice([lambda: t.__setitem__(i, rng.choice(words)), lambda: t.insert(i, rng.choice(words))])()
            out[f"f{f:02}v{v}"] = " ".join(t)
    return out


def exact(data, k, least):
    sets = {key: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for key, t in data.items() for w in [re.findall(r"[^\W_]+", t.lower())]}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def run(spark, data, k=3, least=0.6, extra=()):
    rows = [(key, "1", t, 0) for key, t in data.items()] + list(extra)
    members, pairs = N.near_duplicates(spark.createDataFrame(rows, "key string, rank string, text string, digest int"), k, least)
    return members, pairs


@pytest.mark.parametrize("k,least", [(3, 0.6), (5, 0.8)])
def test_pairs_equal_brute_force(spark, k, least):
    data = texts()
    members, pairs = run(spark, data, k, least)
    got = {(r["a"], r["b"]) for r in N.member_pairs(members, pairs).collect()}
    assert got == exact(data, k, least) and len(got) > 8


def test_hot_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 3)
    data = {f"{s}{key}": t for s in range(3) for key, t in texts(10, seed=10 + s).items()}
    shared = " ".join(f"b{i}" for i in range(40))
    data |= {f"hot{i:02}": shared + " " + " ".join(f"x{i}y{j}" for j in range(30)) for i in range(40)}
    members, pairs = run(spark, data)
    assert {(r["a"], r["b"]) for r in N.member_pairs(members, pairs).collect()} == exact(data, 3, 0.6)


def test_copies_old_states_nulls_and_short_texts(spark, monkeypatch):
    data = {f"c{i}": "one two three four five six" for i in range(6)} | {"z": "One, two three! four five six seven", "s": "two words", "e": ""}
    extra = [("z", "0", "an old state that is something else entirely", 0), ("n", "1", None, 0)]
    members, pairs = run(spark, data, extra=extra)
    got = {(r["a"], r["b"]) for r in N.member_pairs(members, pairs).collect()}
    assert got == exact(data, 3, 0.6) and len(got) == 15 + 6
    rows = {r["key"]: (r["class_id"], r["group_id"], r["n_links"]) for r in N.groups(members, pairs).collect()}
    assert rows["c3"] == ("c0", "c0", 1) and rows["z"] == ("z", "c0", 1) and rows["s"] == ("s", "s", 0) and rows["n"][0] == "n" and len(rows) == 10
    monkeypatch.setattr(N, "COPIES", 4)
    star = {(r["a"], r["b"]) for r in N.member_pairs(members, pairs).collect()}
    assert star == {("c0", f"c{i}") for i in range(1, 6)} | {("c0", "z")}


def test_empty_table(spark):
    members, pairs = run(spark, {})
    assert members.count() == 0 and pairs.count() == 0 and N.groups(members, pairs).count() == 0


def test_estimate_is_close(spark):
    rng = np.random.default_rng(0)
    for share in (0.2, 0.6, 0.9):
        a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        n = int(2 * share / (1 + share) * 3000)
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 3000 - n, dtype=np.uint64)])
        got = N.estimate(N.registers(np.unique(a))[None], N.registers(np.unique(b))[None], np.array([3000.0]), np.array([3000.0]))[0]
        assert abs(got - n / (6000 - n)) < N.SURE


@pytest.mark.parametrize("block", [512, 7])
def test_a_hot_band_is_enough(spark, monkeypatch, block):
    monkeypatch.setattr(N, "HOT", 3)
    monkeypatch.setattr(N, "BLOCK", block, raising=False)
    rng = random.Random(8)
    data = {}
    for v in range(60):
        t = [f"w{i}" for i in range(450)]
        for i in rng.sample(range(450), 19):
            t[i] = f"v{v}x{i}"
        data[f"v{v:02}"] = " ".join(t)
    bands = {key: N.band_keys(N.registers(N.Shingler(3)(t)), N.bands(0.6)) for key, t in data.items()}
    shared = {(a, b): int((bands[a] == bands[b]).sum()) for a, b in exact(data, 3, 0.6)}
    _, pairs = run(spark, data)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {p for p, n in shared.items() if n}
    assert sum(n == 1 for n in shared.values()) > 2


def test_words_are_runs_of_letters_and_digits():
    shingle = N.Shingler(1)
    for text in ("", " ", "_", "a", "One two_three, four-5 six", "Ünïcödé straße ИВАН 東京2020 x²y", "\ud800a \u0130b", "a" * 40_000 + " b"):
        words = re.findall(r"[^\W_]+", text.lower())
        got = shingle.words(text)
        assert len(got) == len(words) and len(set(got.tolist())) == len(set(words))
    assert shingle.words("x alpha beta")[1] == shingle.words("ALPHA")[0]


@pytest.mark.parametrize("size", [1, 2, 5, 20, 100, 1500])
def test_registers_are_equal_as_often_as_sets_overlap(size):
    rng = np.random.default_rng(3)
    shares, n = [], 60 if size < 500 else 10
    for _ in range(n):
        every = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        both = -(-3 * size // 4)
        a, b = N.registers(np.unique(every[:size])), N.registers(np.unique(np.concatenate([every[:both], every[size : 2 * size - both]])))
        shares.append((a == b).mean() - both / (2 * size - both))
    assert abs(np.mean(shares)) < 0.02 and max(map(abs, shares)) < 0.16


def test_recall_of_the_bands():
    rng, band = np.random.default_rng(4), N.bands(0.6)
    for size in (6, 30, 200):
        hits = 0
        for _ in range(300):
            every, both = rng.integers(0, 2**63, 2 * size, dtype=np.uint64), -(-3 * size // 4)
            a, b = N.registers(np.unique(every[:size])), N.registers(np.unique(np.concatenate([every[:both], every[size : 2 * size - both]])))
            hits += (N.band_keys(a, band) == N.band_keys(b, band)).any()
        assert hits >= 0.98 * 300


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_runs_across_batches(monkeypatch, cut):
    import pandas as pd

    monkeypatch.setattr(N, "HOT", 4)
    keys = np.repeat([-5, -1, 0, 3, 8, 9], [1, 2, 4, 5, 11, 3])
    rows = pd.DataFrame({"k": keys, "no": np.arange(len(keys))[::-1]})
    out = pd.concat(N._runs(rows.iloc[i : i + cut] for i in range(0, len(rows), cut)))
    pairs = {(r.k, r.a, r.b) for r in out.itertuples() if r.b >= 0}
    assert len(pairs) == 1 + 6 + 3 and all(a < b for _, a, b in pairs)
    assert sorted(out[out.b < 0].k) == [3] * 5 + [8] * 11 and not list(N._runs(iter([]))) 


def test_candidates_grow_with_the_records(spark):
    made = []
    for n in (150, 600):
        rng = random.Random(n)
        words = [f"w{i}" for i in range(300)]
        data = {f"r{i:04}": " ".join(rng.choices(words, k=120)) for i in range(n)}
        data |= {f"s{i:04}": data[f"r{i:04}"] + " tail" for i in range(n // 5)}
        rows = spark.createDataFrame([(k, "1", t) for k, t in data.items()], "key string, rank string, text string")
        classes = N.sketches(rows, 3).selectExpr("monotonically_increasing_id() AS no", "n", "regs")
        made.append(N.class_candidates(classes, 0.6).count())
    assert made == [30, 120]
