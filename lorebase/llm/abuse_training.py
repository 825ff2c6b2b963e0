"""Training of the abuse network on rated documents.

Ratings are per document, the abuse is a sentence of it. A linear model over word pairs of sentences, fitted so that a
document's worst sentence explains its rating, finds the sentences; the network is then trained by back-propagation
through time on windows around them, with negatives from all other windows. At most ``MOST`` rated documents are used
(the first in the order of a hash of their ids).

    python -m lorebase.llm.abuse_training --train FOLDER [FOLDER ...] --held-out FOLDER
"""

from __future__ import annotations

import argparse
import re

import numpy as np
import pandas as pd
import xxhash

from lorebase.llm import abuse
from lorebase.llm.abuse import DIM, GRAM_ROWS, HIDDEN, PAD, WINDOW, WORD_ROWS, Network, canonical, rows_of, words_of

MOST = 20_000
SPLIT = re.compile(r"(?<=[.!?])\s+|\n+")
BUCKETS = 1 << 18
SURE = 2.0  # least linear score of a sentence by which it explains a rating
BOUNDS = (-2.0, 2.0)  # of the logit above which a sentence of an abusive document is abusive (raters overlook abuse, which raises the quantiles)
USUAL = (0.9985, 0.9995)  # by round, share of the sentences of documents rated 0 that are taken to be harmless


def rated(folder: str) -> pd.DataFrame:
    """doc_id, text, abusive (0 or 1) of the documents whose raters agree on more than half."""
    import pyarrow.dataset as ds

    labels = ds.dataset(f"{folder}/labels.parquet").to_table(columns=["doc_id", "abusive"]).to_pandas().dropna()
    mean = labels.groupby("doc_id").abusive.mean()
    mean = mean[mean != 0.5]
    docs = ds.dataset(f"{folder}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pandas()
    both = docs.merge(mean.rename("abusive").reset_index(), on="doc_id").dropna(subset=["text"])
    both["abusive"] = (both.abusive > 0.5).astype(int)
    order = [xxhash.xxh64_intdigest(f"{folder}/{i}") for i in both.doc_id]
    return both.iloc[np.argsort(order)][:MOST].reset_index(drop=True)


def _features(sentence: list[str]) -> np.ndarray:
    forms = [f for f in map(canonical, sentence) if f]
    return np.unique([xxhash.xxh32_intdigest(x) % BUCKETS for x in [*forms, *map(" ".join, zip(forms, forms[1:]))]]).astype(np.int64)


def sentence_scores(docs: list[list[list[str]]], y: np.ndarray, epochs: int = 6) -> list[np.ndarray]:
    """Score of each sentence (> 0: abusive) from ratings of whole documents."""
    feats = [[_features(s) for s in d] for d in docs]
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d, label in zip(feats, y):
        if d:
            (pos if label else neg)[np.unique(np.concatenate(d))] += 1
    w = 0.5 * (np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 1.5) / ((1 - y).sum() + 3)))
    w[pos + neg < 3] = 0
    b, rng = -3.0, np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(feats)):
            if feats[i]:
                s = np.array([w[f].sum() + b for f in feats[i]])
                k = int(s.argmax())
                g = 1 / (1 + np.exp(-s[k])) - y[i]
                w[feats[i][k]] -= 0.1 * g
                b -= 0.02 * g
    return [np.array([w[f].sum() + b for f in d]) for d in feats]


_SWAPS = {"i": "1", "o": "0", "e": "3", "a": "4", "s": "$"}


def disguise(word: str, rng: np.random.Generator) -> str:
    """One of the disguises a writer might use."""
    kind = rng.integers(5)
    if len(word) < 4 or not word.isalpha():
        return word
    if kind == 0:
        return "".join(_SWAPS.get(c.lower(), c) if rng.random() < 0.6 else c for c in word)
    if kind == 1:
        return word[0] + "*" * (len(word) - 2) + word[-1]
    if kind == 2:
        return ".".join(word)
    if kind == 3:
        k = rng.integers(1, len(word))
        return word[:k] + word[k - 1] * 3 + word[k:]
    return word[: len(word) // 2] + "*" + word[len(word) // 2 + 1 :]


class Trainer:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        r = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {
            "word": r(WORD_ROWS, DIM, k=0.3), "gram": r(GRAM_ROWS, DIM, k=0.3), "wx": r(2 * DIM, 6 * HIDDEN, k=0.3), "bx": np.zeros(6 * HIDDEN, np.float32),
            "uf": r(HIDDEN, 3 * HIDDEN, k=0.25), "ub": r(HIDDEN, 3 * HIDDEN, k=0.25), "va": r(2 * HIDDEN, k=0.3), "vo": r(2 * HIDDEN, k=0.3), "bo": np.array([-1.0], np.float32),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0
        self.rows: dict[str, tuple[int, np.ndarray]] = {}

    def step(self, windows: list[list[str]], y: np.ndarray, rate: float) -> float:
        p, n = self.p, len(windows)
        vocabulary = {PAD: 0}
        ids = np.zeros((n, WINDOW), np.int64)
        for i, w in enumerate(windows):
            ids[i, : len(w)] = [vocabulary.setdefault(x, len(vocabulary)) for x in w]
        rows = []
        for w in vocabulary:
            if w not in self.rows:
                self.rows[w] = rows_of(w)
            rows.append(self.rows[w])
        word_row = np.array([a for a, _ in rows])
        sizes = np.array([len(g) for _, g in rows])
        grams = np.concatenate([g for _, g in rows])
        starts = np.cumsum(sizes) - sizes
        x = np.concatenate([p["word"][word_row], np.add.reduceat(p["gram"][grams], starts) / sizes[:, None]], 1).astype(np.float32)
        gates = x @ p["wx"] + p["bx"]
        H = HIDDEN
        states, tape = np.zeros((WINDOW, n, 2 * H), np.float32), [[], []]
        for side, u in ((0, p["uf"]), (1, p["ub"])):
            h = np.zeros((n, H), np.float32)
            for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                a = gates[ids[:, t], side * 3 * H : (side + 1) * 3 * H]
                g = h @ u
                z = 1 / (1 + np.exp(-(a[:, :H] + g[:, :H])))
                r = 1 / (1 + np.exp(-(a[:, H : 2 * H] + g[:, H : 2 * H])))
                c = np.tanh(a[:, 2 * H :] + r * g[:, 2 * H :])
                tape[side].append((t, h, z, r, c, g[:, 2 * H :]))
                h = c + z * (h - c)
                states[t, :, side * H : (side + 1) * H] = h
        energy = states @ p["va"]
        energy[(ids == 0).T] = -1e9
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        value = states @ p["vo"]
        logit = (weight * value).sum(0) + p["bo"][0]
        prob = 1 / (1 + np.exp(-logit))
        loss = -np.mean(np.log(np.where(y > 0.5, prob, 1 - prob) + 1e-9))
        d = ((prob - y) / n).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["bo"][0] = d.sum()
        dvalue = weight * d
        denergy = weight * (value - (weight * value).sum(0)) * d
        grad["vo"] = np.einsum("tn,tnh->h", dvalue, states)
        grad["va"] = np.einsum("tn,tnh->h", denergy, states)
        dstates = dvalue[:, :, None] * p["vo"] + denergy[:, :, None] * p["va"]
        dgates = np.zeros_like(gates)
        for side, name in ((0, "uf"), (1, "ub")):
            u, dh = p[name], np.zeros((n, H), np.float32)
            for t, h, z, r, c, gc in reversed(tape[side]):
                dh = dh + dstates[t, :, side * H : (side + 1) * H]
                dz = dh * (h - c) * z * (1 - z)
                dc = dh * (1 - z) * (1 - c * c)
                dr = dc * gc * r * (1 - r)
                dg = np.concatenate([dz, dr, dc * r], 1)
                grad[name] += h.T @ dg
                np.add.at(dgates[:, side * 3 * H : (side + 1) * 3 * H], ids[:, t], np.concatenate([dz, dr, dc], 1))
                dh = dh * z + dg @ u.T
        grad["wx"], grad["bx"] = x.T @ dgates, dgates.sum(0)
        dx = dgates @ p["wx"].T
        np.add.at(grad["word"], word_row, dx[:, :DIM])
        np.add.at(grad["gram"], grams, np.repeat(dx[:, DIM:] / sizes[:, None], sizes, 0))
        self.t += 1
        for k, g in grad.items():
            g = g + 1e-5 * p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        return float(loss)


def windows_of(sentences: list[list[str]], scores: np.ndarray, label: int, rng: np.random.Generator) -> tuple[list[list[str]], list[int]]:
    """(windows, labels) of a document, from a random offset; windows with an unclear sentence or a part of an abusive
    one are left out. A sentence of an abusive document is abusive above 0; others above 0 are unclear."""
    words = [w for s in sentences for w in s]
    sizes = [len(s) for s in sentences]
    at = np.cumsum([0, *sizes])
    bad = [i for i in range(len(sizes)) if scores[i] > 0 and label]
    hot, vague = np.zeros(len(words), np.int8), np.zeros(len(words), np.int8)
    for i in range(len(sizes)):
        if scores[i] > 0 and label:
            hot[at[i] : at[i + 1]] = 1
        elif scores[i] > (-3 if label else 0):
            vague[at[i] : at[i + 1]] = 1
    out, labels = [], []
    start = -int(rng.integers(0, WINDOW // 2))
    while start < len(words):
        a, b = max(0, start), min(len(words), start + WINDOW)
        start += abuse.STRIDE
        if b - a < 1 or vague[a:b].any():
            continue
        inside = max(((min(b, at[i + 1]) - max(a, at[i])) / sizes[i] for i in bad if at[i] < b and at[i + 1] > a), default=0.0)
        if 0 < inside < 0.7:
            continue
        out.append([disguise(x, rng) if h and rng.random() < 0.08 else x for x, h in zip(words[a:b], hot[a:b])])
        labels.append(int(inside > 0))
    return out, labels


def _train(sentences, scores, y, epochs: int, seed: int, say, size: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    trainer = Trainer(seed)
    for epoch in range(epochs):
        windows, labels = [], []
        for d, s, label in zip(sentences, scores, y):
            if len(d) and not (label and s.max() <= 0):  # a rating that no sentence explains is taken for an error
                w, ls = windows_of(d, s, int(label), rng)
                windows += w
                labels += ls
        labels = np.array(labels, np.float32)
        keep = np.concatenate([np.flatnonzero(labels == 1), rng.permutation(np.flatnonzero(labels == 0))[: 12 * int(labels.sum())]])
        keep = rng.permutation(keep)
        rate = 0.01 * (0.5 ** (max(0, epoch - 2)))
        losses = []
        for i in range(0, len(keep) - size // 2, size):
            j = keep[i : i + size]
            batch = [[w if rng.random() > 0.03 else PAD + "?" for w in windows[k]] for k in j]
            losses.append(trainer.step(batch, labels[j], rate))
        say(f"epoch {epoch}: {len(keep)} windows, {int(labels.sum())} abusive, loss {np.mean(losses):.4f}")
    return trainer.p


def fit(docs: pd.DataFrame, epochs: int = 8, seed: int = 0, say=print, size: int = 256) -> dict[str, np.ndarray]:
    """Parameters of the network. Twice, a network trained on the sentences found so far names the abusive sentences again: those
    of documents rated 1 that score above nearly all sentences of documents rated 0. So raters' errors are not learnt."""
    sentences = [[words for s in SPLIT.split(t) if (words := words_of(s))] for t in docs.text]
    y = docs.abusive.to_numpy()
    scores = [s - SURE if len(s) else s for s in sentence_scores(sentences, y)]
    for turn, share in enumerate(USUAL):
        network = Network(_train(sentences, scores, y, max(2, epochs - 3), seed + turn, say, size))
        network.learn({w for d in sentences for s in d for w in s[:WINDOW]})
        logits = []
        for d in sentences:
            rows = [network.ids(s[:WINDOW]) for s in d]
            logits.append(network.logits(np.array([np.pad(r, (0, WINDOW - len(r))) for r in rows])) if rows else np.zeros(0))
        usual = float(np.clip(np.quantile(np.concatenate([s for s, label in zip(logits, y) if not label]), share), *BOUNDS))
        say(f"sentences of documents rated 0 are below {usual:.2f}")
        scores = [s - usual for s in logits]
    return _train(sentences, scores, y, epochs, seed + 2, say, size)


def best_threshold(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(the middle of the thresholds of greatest F1, that F1)."""
    steps, found = np.linspace(0.05, 0.95, 91), []
    for t in steps:
        hit = scores >= t
        found.append(2 * (hit & (y == 1)).sum() / max(1, hit.sum() + y.sum()))
    best = np.flatnonzero(np.array(found) >= max(found) - 5e-4)
    return float(np.median(steps[best])), float(max(found))


def main() -> None:
    ask = argparse.ArgumentParser()
    ask.add_argument("--train", nargs="+", required=True)
    ask.add_argument("--held-out", required=True)
    ask.add_argument("--epochs", type=int, default=8)
    ask.add_argument("--out", default=abuse.MODEL)
    args = ask.parse_args()
    docs = pd.concat([rated(f) for f in args.train]).drop_duplicates("text")
    parameters = fit(docs, args.epochs)
    stored = {k: v.astype(np.float16) for k, v in parameters.items()}
    held = rated(args.held_out)
    held = held[~held.text.isin(set(docs.text))]
    network = Network(stored)
    train_scores = np.array(network.score(docs.text.tolist()))
    threshold, f1 = best_threshold(train_scores, docs.abusive.to_numpy())
    threshold = float(np.clip(threshold, 0.3, 0.9))
    scores, y = np.array(network.score(held.text.tolist())), held.abusive.to_numpy()
    hit = scores >= threshold
    print(f"train {len(docs)} documents, F1 {f1:.4f} at {threshold:.2f}; held out {len(held)}: precision {(hit & (y == 1)).sum() / max(1, hit.sum()):.4f}, recall {(hit & (y == 1)).sum() / max(1, y.sum()):.4f} against single ratings")
    np.savez_compressed(args.out, threshold=np.array(threshold), **stored)


if __name__ == "__main__":
    main()
