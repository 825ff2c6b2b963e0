"""Splitting oversized items at natural boundaries, with balanced pieces and overlap.

Only oversized items reach Python, one at a time; everything else stays a single piece made by Spark.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import current_pages

HEADING, PARAGRAPH, LINE, SENTENCE, WORD = 5, 4, 3, 2, 1
_BREAKS = re.compile(r"(?P<gap>(?:\r?\n|\r)(?:[ \t]*(?:\r?\n|\r))*)(?P<head>\#{1,6}[ \t]|={3,}|-{3,})?|(?<=[.!?…。！？])[\"'”’»)\]]*[ \t]+|(?P<cjk>[。！？])|[ \t]+")
_FENCE = re.compile(r"^[ \t]*(```|~~~)", re.M)
PIECES = "src string, item_key string, piece_no int, n_pieces int, first long, last long, text string"


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions at which a piece may begin, ascending, with their strengths; inside code fences lines count as words."""
    fences = [m.start() for m in _FENCE.finditer(text)]
    at, strength, inside, nth = [], [], False, 0
    for m in _BREAKS.finditer(text):
        while nth < len(fences) and fences[nth] < m.end():
            inside, nth = not inside, nth + 1
        if gap := m.group("gap"):
            level = HEADING if m.group("head") else PARAGRAPH if gap.count("\n") + gap.replace("\r\n", "").count("\r") > 1 else LINE
            place = m.start("head") if m.group("head") else m.end()
            if inside:
                level = min(level, WORD)
        else:
            level = SENTENCE if m.group("cjk") or text[m.start() - 1 : m.start()] in tuple(".!?…。！？") or m.group()[0] not in " \t" else WORD
            place = m.end()
        if 0 < place < len(text):
            at.append(place)
            strength.append(level)
    return at, strength


def _between(at: list[int], low: float, high: float) -> range:
    from bisect import bisect_left, bisect_right

    return range(bisect_left(at, low), bisect_right(at, high))


_ZWJ = "\u200d"


def _inside(text: str, at: int) -> bool:
    """Whether a position lies within what is seen as one character."""
    c, before = text[at], text[at - 1]
    return bool(unicodedata.combining(c)) or c in (_ZWJ, "\ufe0e", "\ufe0f") or "\U0001f3fb" <= c <= "\U0001f3ff" or before == _ZWJ or (before == "\r" and c == "\n")


def unbroken(text: str, at: int, step: int, bound: int) -> int:
    """The position nearest to ``at``, up to ``bound`` in the direction of ``step``, that cuts no seen character; ``at`` itself if there is none."""
    place = at
    while place != bound and 0 < place < len(text) and _inside(text, place):
        place += step
    return at if 0 < place < len(text) and _inside(text, place) else place


def spans(size: int, limit: int, overlap: int, at: list[int], strength: list[int], overlap_start, even=lambda place, floor: place) -> list[tuple[int, int]]:
    """Balanced spans [start, end) covering 0..size, each at most ``limit`` long.

    ``overlap_start(cut, previous cut)`` says where a span begins, ``even(place, previous cut)`` where to cut near a
    target without any boundary. ValueError if no count of spans keeps the limit (one below 1).

    The least count that could do is tried first: equal targets, each moved to the strongest boundary within a fifth of
    a piece (ties: the nearest), or left in place where there is none; while a span exceeds the limit, the count grows.
    """
    if size <= limit:
        return [(0, size)]
    count = max(2, -(-(size - overlap) // max(1, limit - overlap)))
    while True:
        step = size / count
        cuts = [0]
        for i in range(1, count):
            target = i * step
            near = [j for j in _between(at, target - step / 5, target + step / 5) if at[j] > cuts[-1]]
            cuts.append(at[max(near, key=lambda j: (strength[j], -abs(at[j] - target)))] if near else even(max(round(target), cuts[-1] + 1), cuts[-1] + 1))
        cuts.append(size)
        found = [(overlap_start(cuts[i], cuts[i - 1]) if i else 0, cuts[i + 1]) for i in range(count)]
        if all(b - a <= limit for a, b in found):
            return found
        if step <= 1:
            raise ValueError(f"pieces of {limit} with an overlap of {overlap} can't cover {size}")
        count += 1


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of code points. A span starts at the first unit that begins at most ``overlap`` before the previous end."""
    at, strength = boundaries(text)

    def back(cut: int, floor: int) -> int:
        low = max(cut - overlap, floor + 1)
        inside = _between(at, low, cut - 1)
        whole = [at[j] for j in inside if strength[j] >= SENTENCE]
        if whole:
            return whole[0]
        if len(inside):
            return at[inside[0]]
        # no unit begins there: a text without any boundary overlaps by characters, otherwise no whole unit fits
        return cut if len(_between(at, cut, cut)) else unbroken(text, low, 1, cut)

    return spans(len(text), limit, overlap, at, strength, back, lambda place, floor: unbroken(text, place, -1, floor))


def split_pages(pages: list[int], first: int, last: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Inclusive page ranges of first..last, cut before section pages where possible."""
    at = sorted({p - first for p in pages if first < p <= last})
    found = spans(last - first + 1, limit, overlap, at, [HEADING] * len(at), lambda cut, floor: max(cut - overlap, floor + 1))
    return [(first + a, first + b - 1) for a, b in found]


def page_pieces(pages: DataFrame, limit: int = 6000, overlap: int = 200, keep_small: bool = True) -> DataFrame:
    """Pieces of the current content of each path: ``src, item_key, piece_no, n_pieces, first, last, text``.

    ``first`` and ``last`` are code-point offsets, ``last`` exclusive. Content up to the limit is one piece; null content
    is one piece with null text and offsets 0. Of a path's rows with the same ``updated`` the longest counts. ``keep_small=False`` returns only the pieces of oversized content and
    then ships no other text between tasks.
    """
    long = F.length("content") > limit
    slim = pages.select("path", "updated", F.length("content").alias("size"), F.col("content") if keep_small else F.when(long, F.col("content")).alias("content"))
    now = current_pages(slim, "size", "content")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["path"], batch["content"]):
                parts = split_text(text, limit, overlap)
                rows += [("pages", key, i + 1, len(parts), a, b, text[a:b]) for i, (a, b) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["src", "item_key", "piece_no", "n_pieces", "first", "last", "text"])

    pieces = now.where(long).mapInPandas(cut, PIECES)
    if not keep_small:
        return pieces
    small = now.where(~F.coalesce(long, F.lit(False)))
    one = small.select(F.lit("pages").alias("src"), F.col("path").alias("item_key"), F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("first"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("last"), F.col("content").alias("text"))
    return pieces.unionByName(one)


def chunk_pieces(chunks: DataFrame, limit: int = 20, overlap: int = 1) -> DataFrame:
    """Pieces of each chunk's page range, ``first`` and ``last`` inclusive; a range written backwards is turned round.

    Repeated rows of a chunk_id count once (the latest ``planned_at``, then the greatest values). A range with a null
    end has no size and stays one piece with its ends as given; null ``section_pages`` are no sections.
    """
    best = F.max(F.struct("planned_at", "start_page", "end_page", F.array_sort(F.coalesce("section_pages", F.array().cast("array<int>"))).alias("sections")))
    once = chunks.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(best.alias("b")).select("chunk_id", "b.*")
    both = F.col("start_page").isNotNull() & F.col("end_page").isNotNull()
    low, high = F.when(both, F.least("start_page", "end_page")).otherwise(F.col("start_page")), F.when(both, F.greatest("start_page", "end_page")).otherwise(F.col("end_page"))
    once = once.select(F.col("chunk_id").cast("string").alias("item_key"), low.cast("long").alias("first"), high.cast("long").alias("last"), "sections")
    long = F.coalesce(F.col("last") - F.col("first") + 1 > limit, F.lit(False))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, first, last, sections in zip(batch["item_key"], batch["first"], batch["last"], batch["sections"]):
                parts = split_pages([int(p) for p in sections if p is not None and p == p], int(first), int(last), limit, overlap)
                rows += [("chunks", key, i + 1, len(parts), a, b, None) for i, (a, b) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["src", "item_key", "piece_no", "n_pieces", "first", "last", "text"])

    one = once.where(~long).select(F.lit("chunks").alias("src"), "item_key", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), "first", "last", F.lit(None).cast("string").alias("text"))
    return once.where(long).mapInPandas(cut, PIECES).unionByName(one)


def oversized(pieces: DataFrame) -> DataFrame:
    """The items that were cut: ``src, item_key``."""
    return pieces.where("n_pieces > 1 AND piece_no = 1").select("src", "item_key")
