"""Abusive, hateful and sexual content: a bidirectional gated recurrent network with attention pooling, in numpy.

A document is scored in all its overlapping windows of ``WINDOW`` words (``STRIDE`` apart, the last one at the end); its
score is the greatest of them, so one sentence in a long document counts as much as in a short one. The input of a word
is an embedding of the word and the mean of embeddings of its character trigrams, both of a canonical form in which
letter substitutions, dotted and stretched spellings are undone. What a word contributes to the gates is computed once
per distinct word and worker.

The network is trained by ``abuse_training`` and stored beside this module; no label is needed to score.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.mixing import source_name

WINDOW, STRIDE = 40, 28
WORD_ROWS, GRAM_ROWS, DIM, HIDDEN = 8192, 4096, 12, 12
WORDS_KEPT = 150_000
MODEL = "abuse_model.npz"
LONGEST = 60  # characters of a word; what is longer is read as several
PAD = "\x00"

_LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i"})
# letters among which others stand for letters; a number before or behind letters is none of these
_SUBSTITUTED = re.compile(r"(?=(?:.*[^\W\d_]){2})(?:[^\W_]|[@$!€|])+")
_NUMBERED = re.compile(r"[^\W\d_]+\d+|\d{2,}[^\W\d_]+|\d[^\W\d_]{1,3}")
_DIGITS = re.compile(r"\d+")
_EDGE = " \t.,;:!?…\"'`’‘“”«»()[]{}<>|_~#/\\-–—=+&^%"
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .]){3,}[^\W\d_](?!\w)")
_MARKS = re.compile(r"[^\W_]+(?:['’*@$!][^\W_]+)*|[^\w\s]{1,60}|_")
_STRETCHED = re.compile(r"(.)\1{2,}")


def canonical(word: str) -> str:
    """Lower case without marks at the edges; digits-only words are ``0``; disguises are undone."""
    bare = word.lower().strip(_EDGE)
    if not bare:
        return ""
    if not any(c.isalpha() or c == "*" for c in bare):
        return "0" if any(c.isdigit() for c in bare) else bare[:4]
    if any(c.isdigit() or c in "@$!€|" for c in bare):
        bare = bare.translate(_LETTERS) if _SUBSTITUTED.fullmatch(bare) and not _NUMBERED.fullmatch(bare) else _DIGITS.sub("0", bare)
    if "." in bare or "-" in bare or "_" in bare:
        parts = re.split(r"[._-]", bare)
        if len(parts) > 2 and max(map(len, parts)) == 1:
            bare = "".join(parts)
    bare = _STRETCHED.sub(lambda m: "*" if m.group(1) == "*" else m.group(1), bare)
    return re.sub(r"\*+", "*", bare)[:LONGEST]


def words_of(text: str) -> list[str]:
    """The words of a text; letters written apart are joined, over-long words fall apart at marks, else into pieces."""
    found = _SPACED.sub(lambda m: m.group().replace(" ", "").replace(".", ""), text).split()
    if all(len(w) <= LONGEST for w in found):
        return found
    return [part[i : i + LONGEST] for w in found for part in ([w] if len(w) <= LONGEST else _MARKS.findall(w) or [w]) for i in range(0, len(part), LONGEST)]


def rows_of(word: str) -> tuple[int, np.ndarray]:
    """The row of a word's canonical form and the rows of its character trigrams."""
    if word == PAD:
        return 0, np.zeros(1, np.int64)
    form = canonical(word)
    marked = f"^{form}$"
    grams = {xxhash.xxh32_intdigest(marked[i : i + 3]) % (GRAM_ROWS - 1) + 1 for i in range(max(1, len(marked) - 2))}
    return xxhash.xxh32_intdigest(form) % (WORD_ROWS - 1) + 1, np.fromiter(grams, np.int64, len(grams))


def window_starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    if n <= window:
        return [0]
    return [*range(0, n - window, stride), n - window]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    return np.add(x, 0.5, out=x)


class Network:
    """Parameters: word, gram (embeddings), wx (inputs to the gates of both directions), bx, uf, ub (recurrent), va
    (attention), vo, bo (output)."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = {k: v.astype(np.float32) for k, v in parameters.items()}
        self.forget()

    def forget(self) -> None:
        self.known = {PAD: 0}
        self.gates = self._gates([PAD])

    def _inputs(self, words: list[str]) -> np.ndarray:
        rows = [rows_of(w) for w in words]
        sizes = np.array([len(g) for _, g in rows])
        flat = self.p["gram"][np.concatenate([g for _, g in rows])]
        mean = np.add.reduceat(flat, np.cumsum(sizes) - sizes) / sizes[:, None]
        return np.concatenate([self.p["word"][[r for r, _ in rows]], mean], 1).astype(np.float32)

    def _gates(self, words: list[str]) -> np.ndarray:
        return self._inputs(words) @ self.p["wx"] + self.p["bx"]

    def learn(self, words: set[str]) -> None:
        new = sorted(words.difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.gates = np.concatenate([self.gates, self._gates(new)])

    def ids(self, words: list[str]) -> np.ndarray:
        """Ids of words that were learnt."""
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """One number per row of word ids; 0 is padding."""
        n, steps = windows.shape
        h3 = 3 * HIDDEN
        energy, value = np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
        for side, u in ((0, self.p["uf"]), (1, self.p["ub"])):
            table = np.ascontiguousarray(self.gates[:, side * h3 : (side + 1) * h3])
            va, vo = self.p["va"][side * HIDDEN : (side + 1) * HIDDEN], self.p["vo"][side * HIDDEN : (side + 1) * HIDDEN]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                x, g = table[windows[:, t]], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                h = c + z * (h - c)
                energy[t] += h @ va
                value[t] += h @ vo
        energy[(windows == 0).T] = -1e9
        weight = np.exp(energy - energy.max(0))
        return (weight * value).sum(0) / weight.sum(0) + self.p["bo"][0]

    def score(self, texts: list[str | None], at_once: int = 4096) -> list[float]:
        """The greatest window score of each text, 0..1; null, empty and blank texts have 0."""
        if len(self.known) > WORDS_KEPT:
            self.forget()
        owner, rows = [], []
        best = np.full(len(texts), -np.inf, np.float32)

        def flush() -> None:
            if rows:
                np.maximum.at(best, np.array(owner), self.logits(np.array(rows)))
                owner.clear()
                rows.clear()

        split = [words_of(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        for i, words in enumerate(split):
            if not words:
                continue
            ids = self.ids(words)
            for start in window_starts(len(ids)):
                row = ids[start : start + WINDOW]
                rows.append(row if len(row) == WINDOW else np.pad(row, (0, WINDOW - len(row))))
                owner.append(i)
                if len(rows) >= at_once:
                    flush()
        flush()
        with np.errstate(over="ignore"):
            return (1 / (1 + np.exp(-best.astype(np.float64)))).tolist()


def load(path: str | None = None) -> tuple[Network, float]:
    """The network of a file, else the one beside this module, also out of a zip."""
    with np.load(path or io.BytesIO(resources.files(__package__).joinpath(MODEL).read_bytes())) as f:
        return Network({k: f[k] for k in f.files if k != "threshold"}), float(f["threshold"])


def score(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, source, score, flagged`` for every document row, repeated ids too.

    Null, empty and blank texts score 0. Equal texts score alike. A text is scored whole, whatever its length. ``source``
    is in lower case without surrounding blanks, null where blank.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network, threshold = load(path)
        for batch in batches:
            found = network.score(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "score": [round(x, 5) for x in found], "flagged": [x >= threshold for x in found]})

    return rows.mapInPandas(run, "doc_id long, source string, score double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """``source, docs, flagged, rate, mean_score``; documents without source are the row of null."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("flagged").cast("long")).alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
