import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lorebase.llm import splitting as S

ALPHABET = st.sampled_from(["word ", "Ende. ", "\n", "\n\n", "\n# Head\n", "\r\n", "x" * 30, "é漢🙂", "👩‍👩‍👧", "e\u0301", "```\ncode\n```\n", "。"])


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, max_size=120).map("".join), st.integers(20, 200), st.integers(0, 15))
def test_pieces_cover_everything_within_the_limit(text, limit, overlap):
    parts = S.split_text(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(b - a <= limit for a, b in parts)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert b - overlap <= c <= b and c > a and d > b


def test_cuts_fall_on_headings_and_overlap_by_whole_units():
    text = "".join(f"# Part {i}\n\n" + "A sentence of the part. " * 40 + "\n\n" for i in range(8))
    parts = S.split_text(text, 2500, 200)
    for (_, b), (c, _) in zip(parts, parts[1:]):
        assert text[b:].startswith("# Part") and 0 < b - c <= 200 and text[c - 1] in " \n"


def test_no_boundary_at_all():
    parts = S.split_text("x" * 13000, 6000, 200)
    assert parts[0][0] == 0 and parts[-1][1] == 13000 and all(b - c == 200 for (_, b), (c, _) in zip(parts, parts[1:]))


def test_a_million_characters():
    text = "\n\n".join("Some words in a row. " * 30 for _ in range(1600))
    parts = S.split_text(text, 6000, 200)
    assert parts[-1][1] == len(text) and len(parts) <= 1.15 * len(text) / 5800 + 1


@settings(max_examples=100, deadline=None)
@given(st.integers(-5, 50), st.integers(0, 150), st.lists(st.integers(-10, 220), max_size=12))
def test_page_ranges(first, more, sections):
    parts = S.split_pages(sections, first, first + more, 20, 1)
    assert parts[0][0] == first and parts[-1][1] == first + more and all(b - a + 1 <= 20 for a, b in parts)
    assert all(b - c + 1 in (0, 1) and c > a for (a, b), (c, _) in zip(parts, parts[1:]))


def test_tables_with_odd_rows(spark):
    pages = spark.createDataFrame([("a", "2026-01-01", "x" * 7000, "t"), ("a", "2026-02-01", "short", "t"), ("b", None, None, "t"), ("c", None, "y" * 6000, "t"), ("d", "", "z " * 4000, "t"), (None, "", "q" * 9000, "t")], "path string, updated string, content string, text string")
    got = S.page_pieces(pages).collect()
    assert {r["item_key"]: r["n_pieces"] for r in got} == {"a": 1, "b": 1, "c": 1, "d": 2}
    assert [r["item_key"] for r in S.oversized(S.page_pieces(pages, keep_small=False)).collect()] == ["d"]
    chunk = "chunk_id long, start_page int, end_page int, section_pages array<int>, planned_at timestamp, first string"
    chunks = spark.createDataFrame([(1, 40, 1, [15, None], None, "c"), (1, 40, 1, [15, None], None, "c"), (2, None, 90, None, None, "c"), (3, 5, 24, None, None, "c"), (None, 1, 99, None, None, "c")], chunk)
    rows = {}
    for r in S.chunk_pieces(chunks).collect():
        rows.setdefault(r["item_key"], []).append((r["piece_no"], r["first"], r["last"]))
    assert sorted(rows["1"])[0][1] == 1 and sorted(rows["1"])[-1][2] == 40 and len(rows["1"]) == 3 and rows["2"] == [(1, None, 90)] and rows["3"] == [(1, 5, 24)]
    assert S.page_pieces(pages.limit(0)).count() == 0 and S.chunk_pieces(chunks.limit(0)).count() == 0


def test_seen_characters_stay_whole():
    for unit in ("👩‍👩‍👧‍👦", "e\u0301\u0323", "👍🏽", "☺\ufe0f"):
        text = unit * 3000
        parts = S.split_text(text, 997, 50)
        assert len(parts) > 2 and all(a % len(unit) == 0 and b % len(unit) == 0 and b - a <= 997 for a, b in parts)
    assert all(b - a <= 100 for a, b in S.split_text("\u0301" * 1000, 100, 10))


def test_impossible_parameters_are_refused():
    import pytest

    with pytest.raises(ValueError):
        S.split_text("x" * 100, 0, 0)


def test_pieces_of_whole_tables(spark, folder):
    from lorebase.llm.queries import QUERIES

    rows = QUERIES["p5_pieces"](spark, folder).toPandas()
    pages = rows[rows.src == "pages"]
    big = {k: g.sort_values("piece_no") for k, g in pages[pages.n_pieces > 1].groupby("item_key")}
    assert big and {("pages", k) for k in big} <= {tuple(r) for r in QUERIES["p5_found"](spark, folder).collect()}
    for g in big.values():
        assert list(g.piece_no) == list(range(1, len(g) + 1)) and set(g.n_pieces) == {len(g)} and g["first"].iloc[0] == 0
        size, sizes = g["last"].max(), g["last"] - g["first"]
        assert all(sizes <= 6000) and all(len(t) == n for t, n in zip(g.text, sizes)) and len(g) <= size // 5800 + 3
        overlaps = g["last"].to_numpy()[:-1] - g["first"].to_numpy()[1:]
        assert ((0 <= overlaps) & (overlaps <= 200)).all() and sizes.min() >= 0.55 * sizes.max()
