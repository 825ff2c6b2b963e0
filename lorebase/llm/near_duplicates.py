"""Near-duplicate records by HyperMinHash.

A record is the set of its word shingles. Each of ``SWEEPS`` rehashes of a shingle falls into one of ``BUCKETS``
buckets; a bucket keeps its least value, stored as the count of leading zeros and the next ``MANTISSA`` bits (two bytes).
A bucket in which no shingle fell takes the value of another, found along a fixed random path (densification), so that
sets of any size have all registers and two sets' registers are equal as often as their similarity says. Bands of
registers give candidate pairs, the collision-corrected share of equal registers estimates the similarity of each, and
the pairs that may pass are verified on their shingle sets.

A band has ``ROWS`` registers, of different rehashes; there are as many bands as find a pair at the threshold with a
probability of ``RECALL``: unrelated records of similarity 0.03 share a band of six with a probability of 1e-7. Records
with equal sets are one class; only one of them takes part. Band keys that very many classes share are found on a sample
beforehand, kept out of the shuffle and compared block by block, as are others that turn out common; no pair is lost, so
recall doesn't depend on how many records are alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.llm.common import page_day
from lorebase.operators.components import components
from lorebase.plans.staging import release, stage

SWEEPS, BUCKETS, MANTISSA = 8, 64, 10
ROWS, RECALL = 6, 0.997
HOT = 256  # classes that may share a key before their pairs are found block by block
BLOCK = 512  # classes in a block
SAMPLE = 32  # one class in so many is looked at for keys that very many share
SURE = 1.0 / math.sqrt(4 * SWEEPS * BUCKETS) * 4.5  # 4.5 standard errors of the estimate at their widest
WORDS = re.compile(r"[^\W_]+")  # what a word is; Shingler finds the same runs
COPIES = 1000  # groups of exact copies up to this size are written as all their pairs
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BITS = np.uint64(BUCKETS.bit_length() - 1)
_SEEDS = (np.arange(1, SWEEPS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
_ROW = (np.arange(SWEEPS, dtype=np.int64) * BUCKETS)[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _word_characters() -> np.ndarray:
    """For each code point whether it belongs to words; made once in a worker."""
    inside = np.zeros(0x110000, bool)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        for m in WORDS.finditer("".join(map(chr, range(low, high)))):
            inside[low + m.start() : low + m.end()] = True
    return inside


class Shingler:
    """Distinct hashes of the ``k``-word shingles of a text.

    Words are the runs of letters and digits of the text in lower case. Each is hashed as a polynomial of its characters
    modulo 2**64, from one running sum over the text.
    """

    _PRIME = 0x9E3779B97F4A7C55
    _INVERSE = pow(_PRIME, -1, 1 << 64)

    def __init__(self, k: int):
        self.k, self.inside = k, _word_characters()
        self._powers(1 << 14)

    def _powers(self, n: int) -> None:
        one = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([one, np.full(n, self._PRIME, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(n, self._INVERSE, np.uint64)]), dtype=np.uint64)

    def words(self, text: str) -> np.ndarray:
        """A hash for each word, in order."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) >= len(self.up):
            self._powers(2 * len(codes))
        inside = np.concatenate([[False], self.inside[codes], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, end = edges[::2], edges[1::2]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes.astype(np.uint64) * self.up[: len(codes)], out=sums[1:])
        return _mix((sums[end] - sums[first]) * self.down[first])

    def __call__(self, text: str) -> np.ndarray:
        ids = self.words(text)
        n = len(ids) - self.k + 1
        if n < 1:
            return np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(self.k):
            h = _mix(h + ids[i : i + n] + np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _paths() -> np.ndarray:
    """For each register the others in the order in which it looks for a value: 64 draws, then all in turn."""
    n = SWEEPS * BUCKETS
    at = np.arange(1, n + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    drawn = _mix(at + np.arange(1, 65, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(n)
    return np.concatenate([drawn.astype(np.int64), (np.arange(n)[:, None] + np.arange(n)[None, :]) % n], 1)


_PATHS = _paths()


def registers(grams: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a set, uint16 of SWEEPS*BUCKETS; of the empty set all 0."""
    if not len(grams):
        return np.zeros(SWEEPS * BUCKETS, np.uint16)
    most = np.iinfo(np.uint64).max
    least = np.full(SWEEPS * BUCKETS, most, np.uint64)
    x = _mix(grams[None, :] ^ _SEEDS)
    place = (x >> np.uint64(64 - int(_BITS))).astype(np.int64) + _ROW
    np.minimum.at(least, place.ravel(), (x << _BITS).ravel() >> _BITS)
    empty = np.flatnonzero(least == most)
    if len(empty):
        full, rest = least != most, empty
        for step in range(_PATHS.shape[1]):
            if not len(rest):
                break
            source = _PATHS[rest, step]
            ok = full[source]
            least[rest[ok]] = least[source[ok]]
            rest = rest[~ok]
    value = np.maximum(least, np.uint64(1))
    high = np.floor(np.log2(value.astype(np.float64))).astype(np.int64)
    high = np.where(value >> np.clip(high, 0, 63).astype(np.uint64) == 0, high - 1, high)  # rounded up
    shift = high - MANTISSA
    bits = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.maximum(-shift, 0).astype(np.uint64))
    return (((63 - int(_BITS) - high).astype(np.uint64) << np.uint64(MANTISSA)) | (bits & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)


def bands(least: float) -> np.ndarray:
    """The registers of each band (bands, ROWS): enough bands for pairs of similarity ``least``, their registers from
    different rehashes."""
    count = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - min(least, 0.999999) ** ROWS)))
    rng = np.random.default_rng(5)
    return np.array([[sweep * BUCKETS + rng.integers(BUCKETS) for sweep in rng.permutation(SWEEPS)[:ROWS]] for _ in range(count)])


def band_keys(regs: np.ndarray, band: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, of one set's registers or of each row of several."""
    rows = regs[..., band].astype(np.uint64)
    key = np.arange(1, len(band) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.zeros(rows.shape[:-1], np.uint64)
    for r in range(ROWS):
        key = _mix(key ^ rows[..., r])
    return key


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (one row per pair), corrected for registers that are equal by chance.

    The least values of two disjoint sets with x and y elements per bucket have the same leading zeros and mantissa with
    a probability of about 0.72 * 2**-MANTISSA * xy/(x+y)**2 (exponential least values, mean cell width 0.72 of a
    value's 2**-MANTISSA).
    """
    share = (a == b).mean(1)
    x, y = n_a / BUCKETS, n_b / BUCKETS
    chance = 0.72 * 2.0**-MANTISSA * x * y / np.maximum((x + y) ** 2, 1e-9)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _signatures(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(k)
        for batch in batches:
            grams = [shingler(t) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "rank": batch["rank"], "digest": batch["digest"], "cls": [xxhash.xxh128_digest(g.tobytes()) for g in grams], "n": [len(g) for g in grams], "regs": [registers(g).tobytes() for g in grams]})

    return run


def sketches(records: DataFrame, k: int) -> DataFrame:
    """``key, rank, digest, cls, n, regs`` of records ``key, rank, text``, staged."""
    rows = records.select("key", "rank", "text", F.xxhash64("text").alias("digest"))
    return stage(rows.mapInPandas(_signatures(k), "key string, rank string, digest long, cls binary, n int, regs binary"), "sketches")


def _keys(least: float):
    band = bands(least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch["regs"]), np.uint16).reshape(len(batch), -1)
            yield pd.DataFrame({"k": band_keys(regs, band).view(np.int64).ravel(), "no": np.repeat(batch["no"].to_numpy(), len(band))})

    return run


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows ``k, no`` sorted by k: the pairs ``a, b`` of each key that at most HOT classes share; the rows of a key
    that more share come out as ``k, a`` without b. No more than HOT rows of a key are held at a time."""
    held_k, held, over = None, np.empty(0, np.int64), False

    def flush(k: int, nos: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if over:
            return [(np.full(len(nos), k), nos, np.full(len(nos), -1))]
        if len(nos) < 2:
            return []
        i, j = np.triu_indices(len(nos), 1)
        nos = np.sort(nos)
        return [(np.full(len(i), k), nos[i], nos[j])]

    def frame(found: list) -> pd.DataFrame:
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("k", "a", "b"), parts)))

    for batch in batches:
        k, no = batch["k"].to_numpy(), batch["no"].to_numpy()
        if not len(k):
            continue
        found = []
        starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        sizes = np.diff(starts)
        several = np.flatnonzero(sizes > 1)
        for i in sorted({0, len(sizes) - 1, *several.tolist()}):
            key, part = int(k[starts[i]]), no[starts[i] : starts[i + 1]]
            if key != held_k:
                if held_k is not None:
                    found += flush(held_k, held)
                held_k, held, over = key, part, False
            else:
                held = np.concatenate([held, part])
            if len(held) > HOT:
                over = True
            if over:
                found += flush(held_k, held)
                held = np.empty(0, np.int64)
        yield frame(found)
    if held_k is not None:
        yield frame(flush(held_k, held))


def _block_pairs(hot: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs of the classes of each too common key (``k, no, c``) that the estimate lets pass.

    The classes of a key are cut into blocks and each pair of blocks is one task's work. A pair comes from the first band
    it shares only.
    """
    blocks = F.ceil(F.col("c") / BLOCK)
    rows = hot.join(classes.select("no", "n", "regs"), "no").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("no"), "blocks"))
    spread = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("k", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "no", "n", "regs")
    band = bands(least)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, k = pdf["x"].iloc[0], pdf["y"].iloc[0], np.uint64(int(pdf["k"].iloc[0]) & 0xFFFFFFFFFFFFFFFF)
        regs = np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(len(pdf), -1)
        keys = band_keys(regs, band)
        no, n, block = pdf["no"].to_numpy(), pdf["n"].to_numpy(float), pdf["block"].to_numpy()
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for at, i in enumerate(left):
            others = right[at + 1 :] if x == y else right
            others = others[np.minimum(n[others], n[i]) >= least * np.maximum(n[others], n[i])]
            others = others[keys[i][(keys[others] == keys[i]).argmax(1)] == k]
            others = others[estimate(regs[i][None], regs[others], n[i], n[others]) >= least - SURE]
            out.append((np.minimum(no[i], no[others]), np.maximum(no[i], no[others])))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip("ab", zip(*out))})

    return spread.groupBy("k", "x", "y").applyInPandas(product, "a long, b long")


def class_candidates(classes: DataFrame, least: float) -> DataFrame:
    """Distinct candidate pairs ``a < b`` of classes (``no, n, regs``), staged."""
    make = _keys(least)
    keys = lambda some: some.select("no", "regs").mapInPandas(make, "k long, no long")
    # the keys of a sample tell which keys far more than HOT classes share; others are met one by one below
    sample = keys(classes.where(F.pmod(F.xxhash64("no"), F.lit(SAMPLE)) == 0)).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    known = stage(sample.where(F.col("c") > HOT / 8).select("k"), "hot-keys")
    every, hot = keys(classes), None
    if not known.isEmpty():
        hot = every.join(known, "k", "left_semi")
        every = every.join(known, "k", "left_anti")
    runs = stage(every.repartition("k").sortWithinPartitions("k").mapInPandas(_runs, "k long, a long, b long"), "key-runs")
    pairs = runs.where("b >= 0").select("a", "b")
    met = runs.where("b < 0").select("k", F.col("a").alias("no"))
    if not met.isEmpty():
        hot = met if hot is None else hot.unionByName(met)
    if hot is not None:
        hot = stage(hot, "common-keys")
        counted = hot.join(hot.groupBy("k").agg(F.count(F.lit(1)).alias("c")), "k")
        pairs = pairs.unionByName(_block_pairs(counted, classes, least))
    found = stage(pairs.distinct(), "candidates")
    release(known, runs, *([hot] if hot is not None else []))
    return found


@F.pandas_udf(T.DoubleType())
def _estimated(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), -1)
    return pd.Series(estimate(x, y, n_a.to_numpy(float), n_b.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _exact(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / max(1, len(x) + len(y) - both))
    return pd.Series(out, dtype=float)


def similar_classes(records: DataFrame, classes: DataFrame, k: int, least: float) -> DataFrame:
    """``a, b, similarity``: verified pairs of class ids, staged. ``classes``: ``no, class_id, rank, digest, n, regs``."""
    # each step first keeps the few rows that the last one left: by a table that was written, so that the planner knows its
    # size, broadcasts it if it is small and joins it by a shuffle if not
    pairs = class_candidates(classes.select("no", "n", "regs"), least)
    met = pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct()
    candidates = stage(met, "candidate-classes")
    side = classes.select("no", "n", "regs").join(candidates, "no", "left_semi")
    both = pairs.join(side.toDF("a", "n_a", "regs_a"), "a").join(side.toDF("b", "n_b", "regs_b"), "b")
    both = both.where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    likely = stage(both.where(_estimated("regs_a", "regs_b", "n_a", "n_b") >= least - SURE).select("a", "b"), "likely")

    # the shingle sets of the classes that are left, made again from their texts
    ends = stage(likely.select(F.explode(F.array("a", "b")).alias("no")).distinct(), "likely-classes")
    chosen = classes.select("no", F.col("class_id").alias("key"), "rank", "digest").join(ends, "no", "left_semi")
    wanted = stage(chosen.select("digest").distinct(), "digests")
    texts = records.withColumn("digest", F.xxhash64("text")).join(wanted, "digest", "left_semi").join(chosen, ["key", "rank", "digest"])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(k)
        for batch in batches:
            yield pd.DataFrame({"no": batch["no"], "id": batch["key"], "grams": [shingler(t).tobytes() for t in batch["text"]]})

    made = texts.select("no", "key", "text").dropDuplicates(["no"]).mapInPandas(sets, "no long, id string, grams binary")
    grams = stage(made, "sets")
    joined = likely.join(grams.toDF("a", "id_a", "grams_a"), "a").join(grams.toDF("b", "id_b", "grams_b"), "b")
    found = joined.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), _exact("grams_a", "grams_b").alias("similarity"))
    found = stage(found.where(F.col("similarity") >= least), "similar")
    release(classes, pairs, candidates, likely, ends, wanted, grams)
    return found


def page_records(pages: DataFrame) -> DataFrame:
    """``key, rank, text, blank`` of page rows; rank orders the states of a path, text is title, blank, content."""
    rank = F.concat_ws("\x01", F.lpad(page_day(F.col("updated")).cast("string"), 8, "0"), F.coalesce("updated", F.lit("")))
    blank = F.coalesce(F.col("content"), F.lit("")).rlike(r"(?U)^\s*$")
    text = F.when(~blank, F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("content"))).otherwise(F.lit(""))
    return pages.where(F.col("path").isNotNull()).select(F.col("path").alias("key"), rank.alias("rank"), text.alias("text"))


def near_duplicates(records: DataFrame, k: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members ``key, class_id``, pairs of class ids ``a, b, similarity``) of records ``key, rank, text``.

    Of several rows of a key the one of highest rank counts. Records with equal shingle sets are one class, named after
    its smallest key. A text of fewer than ``k`` words has no shingles and belongs to a class of its own; null texts
    count as empty. Word runs are letters and digits in lower case.
    """
    records = records.select("key", "rank", F.coalesce("text", F.lit("")).alias("text"))
    made = sketches(records, k)
    current = made.groupBy("key").agg(F.max(F.struct("rank", "digest", "cls", "n")).alias("s")).select("key", "s.*")
    current = stage(current, "current")
    names = current.where("n > 0").groupBy("cls").agg(F.min(F.struct("key", "rank", "digest")).alias("s")).select("cls", "s.*")
    members = current.where("n > 0").select("key", "cls").join(names.select("cls", F.col("key").alias("class_id")), "cls").select("key", "class_id")
    members = stage(members.unionByName(current.where("n = 0").select("key", F.col("key").alias("class_id"))), "members")
    chosen = made.select("key", "rank", "digest", "n", "regs").join(names.select("key", F.col("rank").alias("_r"), F.col("digest").alias("_d")), "key").where("rank = _r AND digest = _d")
    classes = chosen.groupBy("key").agg(F.max(F.struct("rank", "digest", "n", "regs")).alias("s")).select(F.col("key").alias("class_id"), "s.*")
    classes = stage(classes.withColumn("no", F.monotonically_increasing_id()), "classes")
    release(made, current)
    return members, similar_classes(records, classes, k, least)


def member_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of keys ``a < b``: of similar classes, and of the copies within a class.

    Groups of more than COPIES exact copies are written as pairs with their representative, and similar classes then
    as pairs of representatives with members, so that no link is lost and nothing grows with the square of such a group.
    """
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"))
    sized = members.join(sizes.where("size > 1"), "class_id")
    shown = sized.where((F.col("size") <= COPIES) | (F.col("key") == F.col("class_id"))).select("class_id", "key")
    single = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct().join(sizes.where("size = 1"), "class_id").select("class_id", F.col("class_id").alias("key"))
    use = shown.unionByName(single)
    across = pairs.join(use.toDF("a", "x"), "a").join(use.toDF("b", "y"), "b").select("x", "y")
    copies = sized.where(F.col("size") <= COPIES).select("class_id", "key")
    within = copies.toDF("c", "x").join(copies.toDF("c", "y"), "c").where("x < y").select("x", "y")
    stars = sized.where((F.col("size") > COPIES) & (F.col("key") != F.col("class_id"))).select(F.col("class_id").alias("x"), F.col("key").alias("y"))
    every = across.unionByName(within).unionByName(stars)
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``key, class_id, group_id, n_links``: one row per record; n_links counts the similar classes of its class."""
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    comp = components(pairs).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    out = members.join(links, "class_id", "left").join(comp, "class_id", "left")
    return out.select("key", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
