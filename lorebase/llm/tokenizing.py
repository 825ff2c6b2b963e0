"""Encoding a corpus with a public byte-level BPE tokenizer, by recursive queries in DuckDB.

Each partition cuts its texts into words (the tokenizer's own pattern). The words it hasn't met go as token-position rows
into a recursive query that joins them with the merge table and contracts each word's pair of least rank, all its
occurrences from the left, until no pair is left; an ordered aggregation gives the word's ids. ``USING KEY`` keeps one
row per position, so a very long word takes no more than its length; words fall apart before that wherever two bytes
meet that stand side by side in no token, as no merge can reach over them, and the pieces are contracted side by side. Words already met are looked up; the memory is
bounded, so a partition needs no more for a larger corpus.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = os.environ.get("LOREBASE_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.json"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS_KEPT = 200_000  # words a partition remembers
ROWS_AT_ONCE = 400_000  # byte positions in one recursive query; a longer word goes alone

MERGE = """
WITH RECURSIVE state(w, p, t) USING KEY (w, p) AS (
    SELECT w, p, t FROM start
    UNION
    (WITH live AS (SELECT DISTINCT w FROM state),
    here AS (
        SELECT r.w, r.p, r.t, lead(r.t) OVER along AS t2, lead(r.p) OVER along AS p2
        FROM recurring.state r SEMI JOIN live ON live.w = r.w WHERE r.t >= 0
        WINDOW along AS (PARTITION BY r.w ORDER BY r.p)),
    pair AS (SELECT here.w, here.p, here.p2, m.id, m.rank FROM here JOIN merges m ON here.t = m.l AND here.t2 = m.r),
    best AS (SELECT w, min(rank) AS rank FROM pair GROUP BY w),
    hit AS (
        SELECT pair.w, pair.p, pair.p2, pair.id,
            coalesce(lag(pair.p2) OVER (PARTITION BY pair.w ORDER BY pair.p) = pair.p, false) AS touches
        FROM pair JOIN best ON pair.w = best.w AND pair.rank = best.rank),
    run AS (SELECT *, sum(CASE WHEN touches THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY p) AS g FROM hit),
    nth AS (SELECT *, row_number() OVER (PARTITION BY w, g ORDER BY p) AS k FROM run)
    SELECT w, p, id FROM nth WHERE k % 2 = 1 UNION ALL SELECT w, p2, -1 FROM nth WHERE k % 2 = 1)
)
SELECT w, list(t ORDER BY p) AS ids FROM state WHERE t >= 0 GROUP BY w ORDER BY w
"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Words to token ids, in one worker."""

    def __init__(self, path: str):
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.letters = np.array([ids[c] for c in byte_letters()], np.int32)
        self.con = duckdb.connect()
        # no folder to spill into: what a query holds is bounded by ROWS_AT_ONCE
        self.con.execute("SET threads=1; SET memory_limit='600MB'; SET temp_directory=''; SET preserve_insertion_order=false")
        merges = pa.table({"l": pa.array([ids[a] for a, _ in pairs], pa.int32()), "r": pa.array([ids[b] for _, b in pairs], pa.int32()), "rank": pa.array(range(len(pairs)), pa.int32()), "id": pa.array([ids[a + b] for a, b in pairs], pa.int32())})
        self.con.register("m", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        # bytes that stand side by side in some token; no merge reaches over any other pair, so words fall apart there
        codes = {c: b for b, c in enumerate(byte_letters())}
        self.joined = np.zeros((256, 256), bool)
        for token in ids:
            if all(c in codes for c in token):
                own = [codes[c] for c in token]
                self.joined[own[:-1], own[1:]] = True
        self.find = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = [np.empty(0, np.int32)]
        self.counts = [np.empty(0, np.int64)]

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has). Words are contracted in pieces between bytes that no token joins."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = ~self.joined[data[:-1], data[1:]]
        firsts = np.cumsum(sizes) - sizes
        begins[firsts[sizes > 0]] = begins[-1] = True
        edges = np.flatnonzero(begins)
        flat, counts, at = [], [], 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + ROWS_AT_ONCE, "right")) - 1)
            own, held = self._contracted(data[edges[at] : edges[to]], np.diff(edges[at : to + 1]))
            flat.append(own)
            counts.append(held)
            at = to
        counts = np.concatenate([np.empty(0, np.int64), *counts])
        whole = np.concatenate([[0], np.cumsum(counts)])
        ends = whole[np.searchsorted(edges, np.concatenate([firsts, [len(data)]]))]
        return np.concatenate([np.empty(0, np.int32), *flat]), np.diff(ends)

    def _contracted(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = pa.table({"w": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "p": place.astype(np.int32), "t": self.letters[data]})
        self.con.register("start", start)
        column = self.con.sql(MERGE).to_arrow_table().column("ids").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.diff(column.offsets.to_numpy()).astype(np.int64)

    def learn(self, words: set[str]) -> None:
        batch: list[str] = []
        rows = 0

        def flush() -> None:
            nonlocal batch, rows
            if batch:
                flat, counts = self._merge([w.encode("utf-8", "surrogatepass") for w in batch])
                self.known.update(zip(batch, range(len(self.known), len(self.known) + len(batch))))
                self.flat.append(flat)
                self.counts.append(counts)
            batch, rows = [], 0

        for w in sorted(words, key=len):
            if batch and rows + len(w) * 2 > ROWS_AT_ONCE:
                flush()
            batch.append(w)
            rows += len(w) * 2
        flush()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ends): the ids of text i are ids[ends[i]:ends[i+1]]."""
        cut = [self.find(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > WORDS_KEPT and self.known:
            self._forget()
            new = set().union(*cut)
        self.learn(new)
        flat, counts = np.concatenate(self.flat), np.concatenate(self.counts)
        self.flat, self.counts = [flat], [counts]
        starts = np.cumsum(counts) - counts
        n = sum(map(len, cut))
        ids = np.fromiter((self.known[w] for words in cut for w in words), np.int64, n)
        size = counts[ids]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[ids], size)
        upto = np.concatenate([[0], np.cumsum(size)])
        ends = upto[np.concatenate([[0], np.cumsum([len(words) for words in cut])]).astype(np.int64)]
        return flat[place], ends


def _slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``most`` characters, at least one row each."""
    sizes = np.cumsum([len(t.as_py() or "") for t in batch.column(column)]) if batch.num_rows else np.empty(0)
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _worker(key: str, key_type: str, path: str, counts_only: bool, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            for batch in _slices(whole, "text"):
                encoder = encoder or Encoder(path)
                ids, ends = encoder.encode(batch.column("text").to_pylist())
                made = pa.array(np.diff(ends), pa.int64()) if counts_only else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [key, *extra]], made], names=[key, *extra, "n_tokens" if counts_only else "ids"])

    return run


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids``: the token ids of each row's text, without special tokens.

    Null and empty texts have the empty list. Strings that look like special tokens are ordinary text. Each row gives
    one row, repeated keys and null keys included; other columns are left out. A text counts whole, whatever its length.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(_worker("key", kind, path or f"{FOLDER}/{TOKENIZER}", False, []), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str, text: str, extra: list[str], path: str | None = None) -> DataFrame:
    """``key, extra..., n_tokens``; null and empty texts have 0."""
    rows = df.select(F.col(key), *extra, F.col(text).alias("text"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [key, *extra]) + ", n_tokens long"
    return rows.mapInArrow(_worker(key, kinds[key], path or f"{FOLDER}/{TOKENIZER}", True, list(extra)), schema)
