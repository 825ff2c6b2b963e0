"""Names of people in running text: a trained tagger of spans.

Spans that could be a name are found by their form: runs of capitalised words and initials with particles between them,
a capitalised word behind a form of address, "Surname, Given", known given names in any case, and two or three words in
lower case that fill a field. A linear model over context, shape, letters and script, trained in numpy by
``names_training``, decides each; of overlapping spans the best wins. No list of surnames or of context words is used:
what the words around a name say is learnt, and names the model never saw are told by form and context.

The score is a sum of weights of hashed features, so what a word adds at its place is computed once per worker.
"""

from __future__ import annotations

import io
import re
import unicodedata
from bisect import bisect_left
from importlib import resources

import numpy as np
import xxhash

BUCKETS = 1 << 17
WORDS_KEPT = 300_000
MODEL = "names_model.npz"
CUT = "\x1e"  # stands between texts that are looked at together; nothing is seen across it
KNOWN = 2.0  # what a known given name or a form of address adds to the score

TITLES = {"mr": "m", "mrs": "f", "ms": "f", "miss": "f", "dr": "n", "prof": "n", "professor": "n", "doctor": "n", "sir": "m", "herr": "m", "herrn": "m", "frau": "f", "mme": "f", "mlle": "f", "madame": "f", "monsieur": "m", "señor": "m", "señora": "f", "senora": "f", "senor": "m", "señorita": "f", "sra": "f", "sr": "m", "don": "m", "doña": "f", "г-н": "m", "г-жа": "f", "господин": "m", "госпожа": "f", "доктор": "n", "профессор": "n", "κύριος": "m", "κ": "m", "κα": "f", "κυρία": "f", "δρ": "n"}
PARTICLES = frozenset("de la los las van der den von vom del dos das da di du el al le bin ibn ten ter zu".split())
_UP = "A-ZÀ-ÖØ-ÞĀ-ſƀ-ɏΆ-ΏΑ-ΫЀ-ЯѠ-ԯԱ-Ֆ"
_PART = r"(?:(?:" + "|".join(sorted(PARTICLES, key=len, reverse=True)) + r")[ \t]+){1,2}"
_GAP = r"[ \t ]+"
_CAPITAL = rf"[{_UP}][^\W\d_]*(?:['’-][^\W\d_]+)*\.?"
#: capitalised words and initials, with particles or a comma between them
RUN = re.compile(rf"[{_UP}](?<![\w@#/'’_-].)(?<!\w\..)[^\W\d_]*(?:['’-][^\W\d_]+)*\.?(?:(?:,?{_GAP}|(?<=\.))(?:(?i:{_PART}))?{_CAPITAL})+(?![\w@/_])")
_IN_RUN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?|,")
_LOW = r"[^\W\d_A-Z]"
FIELD = re.compile(rf"[|:\"] ?(?P<n>{_LOW}{{2,}}(?:['’-]{_LOW}+)*(?:[ \t][^\W\d_]\.)?(?:[ \t]{_LOW}{{2,}}(?:['’-]{_LOW}+)*){{1,3}})(?=[ \t]*(?:[|\"\n{CUT}]|$))")
_CONTEXT = re.compile(r"\n|[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\w\s\"\\{}()*]|_")
_HONOURED = re.compile(r"(?<![一-鿿])[一-鿿]{1,4}?(?=先生|女士|小姐|氏|様|さん)|[가-힣]{2,4}(?=[ \t]?(?:씨|님))|[゠-ヿ]{2,10}(?=さん|様|氏)")


def script_of(c: str) -> str:
    if c < "ɐ":
        return "LATIN"
    return unicodedata.name(c, "OTHER").split()[0]


def is_title(word: str) -> bool:
    """A form of address; ``MS`` in capitals is a unit."""
    return word != "MS" and word.lower().rstrip(".") in TITLES


def _shape(w: str) -> str:
    if len(w) == 1 or w.endswith("."):
        return "i" if len(w) <= 2 else "a"
    if w.isupper():
        return "U"
    if w[0].isupper():
        return "C" if w[1:].replace("-", "").replace("'", "").replace("’", "").islower() else "M"
    return "l"


def features(text: str, a: int, b: int, words: list[str], before: bool, behind: bool, known: bool, level) -> list[tuple[str, str]]:
    """(place, what) of a span; place ``=`` is a feature as it stands, any other a word at that place.

    ``words``: the span's words, commas among them. ``before``, ``behind``: it touches more capitalised words of its run.
    ``level(word)``: how much of an ordinary word it is, 0 to 4.
    """
    start = max(text.rfind(CUT, 0, a) + 1, a - 48)
    left = _CONTEXT.findall(text, start, a)
    if start and text[start - 1] != CUT and left:
        left = left[1:]  # its beginning may be cut off
    cut = text.find(CUT, b, b + 32)
    right = _CONTEXT.findall(text, b, cut if cut >= 0 else b + 32)[:3]
    left = [w.lower() if w[0].isalpha() else "0" if w[0].isdigit() else w for w in left[-3:]]
    right = [w.lower() if w[0].isalpha() else "0" if w[0].isdigit() else w for w in right]
    l1, l2, l3 = ([""] * 3 + left)[-1], ([""] * 3 + left)[-2], ([""] * 3 + left)[-3]
    r1, r2 = [*right, "", ""][:2]
    kinds, names = "", []
    for i, w in enumerate(words):
        low = w.lower().rstrip(".")
        if w == ",":
            kinds += ","
        elif i == 0 and len(words) > 1 and is_title(w):
            kinds += "T"
        elif low in PARTICLES and 0 < i < len(words) - 1:
            kinds += "p"
        else:
            kinds += _shape(w)
            if len(low) > 1:
                names.append(low)
    scripts = {script_of(n[0]) for n in names}
    around = next((script_of(w[0]) for w in reversed(left) if w[0].isalpha()), next((script_of(w[0]) for w in right if w[0].isalpha()), ""))
    first, last = (names[0], names[-1]) if names else ("", "")
    ordinary = f"{level(first)}{level(last)}" if names else "-"
    at, edge = text[a - 1 : a].replace(CUT, "") or "^", text[b : b + 1].replace(CUT, "") or "$"
    inside = f"{before:d}{behind:d}"
    out = [
        ("=", f"kinds {kinds}"), ("=", f"kinds {kinds} l1 {l1}"), ("=", f"kinds {kinds} in {inside}"), ("=", f"in {inside} l1 {l1}"), ("=", f"l1 {l1} l2 {l2}"), ("=", f"l2 {l2} l3 {l3} l1 {l1}"), ("=", f"r1 {r1} r2 {r2}"),
        ("=", f"at {at!r} {edge!r}"), ("=", f"at {at!r} {kinds}"), ("=", f"l1 {l1}"), ("=", f"l2 {l2}"), ("=", f"r1 {r1}"), ("=", f"given {known:d} {kinds}"), ("=", f"script {'+'.join(sorted(scripts))} in {around}"), ("=", f"script {'+'.join(sorted(scripts))} {kinds}"),
        ("=", f"ordinary {ordinary}"), ("=", f"ordinary {ordinary} {kinds} {known:d}"), ("=", f"ordinary {ordinary} l1 {l1}"), ("=", f"ordinary {ordinary} in {inside} {kinds}"), ("=", f"ordinary {ordinary} r1 {r1}"), ("=", f"ordinary {ordinary} at {at!r} {known:d}"), ("=", f"ordinary {ordinary} {known:d} l1 {l1} {inside}"),
    ]
    if len(names) > 1:
        out += [("first", first), ("last", last), *[("mid", m) for m in names[1:-1]]]
    elif names:
        out += [("only", last)]
    return out


def parts(place: str, what: str) -> list[tuple[int, float]]:
    """(row, factor) of the weights that a feature adds."""
    h = lambda x: xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass"))
    if place == "=":
        return [(h(what) % BUCKETS, 1.0)]
    marked = f"^{what}$"
    base = BUCKETS if place == "word" else 0  # a table of its own
    out = [(h(f"{place} {what}") % BUCKETS + base, 1.0), *((h(f"{place} {x}") % BUCKETS + base, 0.5) for x in (f"size {min(len(what), 12)}", f"end {what[-3:]}", f"end {what[-2:]}"))]
    grams = {marked[i : i + n] for n in (3, 4) for i in range(len(marked) - n + 1)}
    share = 1.5 / max(1, len(grams)) ** 0.5
    return [*out, *((h(f"gram {g}") % BUCKETS + base, share) for g in grams)]


class Tagger:
    """``given``: words known to be given names; they make a span in any case."""

    def __init__(self, given: frozenset[str], weights: np.ndarray | None = None, threshold: float = 0.0):
        if weights is None:
            weights, threshold = load()
        self.weights, self.threshold, self.given, self.known = weights, threshold, given, {}

    def _add(self, feature: tuple[str, str]) -> float:
        value = self.known.get(feature)
        if value is None:
            if len(self.known) > WORDS_KEPT:
                self.known.clear()
            value = self.known[feature] = float(sum(self.weights[row] * factor for row, factor in parts(*feature)))
        return value

    def level(self, word: str) -> int:
        """How much of an ordinary word a word is: by its letters, and by itself where it was met in training."""
        value = self._add(("word", word))
        return 0 if value < -3 else 1 if value < -0.7 else 2 if value < 0.7 else 3 if value < 3 else 4

    def score(self, found: list[tuple[str, str]]) -> float:
        return sum(map(self._add, found))

    def spans(self, text: str, low: str, given: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The names of a text, ascending, not overlapping; ``given``: where known given names stand in it."""
        scored = []
        seen = set()
        for a, b, words, before, behind, known in candidates(text, low, given, self.given):
            if (a, b) not in seen:
                seen.add((a, b))
                # two ordinary words, neither a known given name nor a form of address: the commonest span by far
                if not known and len(words) == 2 and not is_title(words[0]) and self.level(words[0].lower()) == 4 == self.level(words[1].lower()):
                    continue
                s = self.score(features(text, a, b, words, before, behind, known, self.level))
                if s + (KNOWN if known or is_title(words[0]) else 0.0) > self.threshold:
                    scored.append((s, a, b))
        scored += [(100.0, *m.span()) for m in _HONOURED.finditer(text)] if not text.isascii() else []
        return apart((a, b) for _, a, b in sorted(scored, key=lambda x: (-x[0], x[1])))


def apart(spans) -> list[tuple]:
    """Of spans ``(start, end, ...)`` in the order of their claims, those that overlap no earlier one; ascending."""
    kept: list[tuple] = []
    for span in spans:
        i = bisect_left(kept, (span[0],))
        if (i == 0 or kept[i - 1][1] <= span[0]) and (i == len(kept) or span[1] <= kept[i][0]):
            kept.insert(i, span)
    return kept


_AFTER = re.compile(rf"(?:-[^\W\d_]+)?{_GAP}(?:[^\W\d_]\.[ \t]*)?(?P<part>(?:{_PART})?)(?P<sur>[^\W\d_]{{3,}}(?:['’][^\W\d_]+)?(?:-[^\W\d_]{{3,}})*)", re.I)
_BEFORE = re.compile(rf"(?P<sur>(?:{_PART})?[^\W\d_]{{3,}}(?:['’][^\W\d_]+)?(?:-[^\W\d_]{{3,}})*),[ \t]+$", re.I)
_TAIL = re.compile(r"[ \t]+[^\W\d_]\.")
_LOWER_INITIAL = re.compile(rf"\.{_GAP}(?:{_PART})?{_LOW}{{3,}}(?:['’-][^\W\d_]+)*(?![\w@/_])")


def candidates(text: str, low: str, given: list[tuple[int, int]], lexicon: frozenset[str]):
    """(start, end, words, touches before, touches behind, holds a known given name) of every span that could be a name."""
    for run in RUN.finditer(text):
        marks = [(m.start() + run.start(), m.end() + run.start()) for m in _IN_RUN.finditer(run.group())]
        words = [text[a:b] for a, b in marks]
        size = len(words)
        # a full stop behind more than an initial ends a sentence, unless a form of address stands before it
        for i, w in enumerate(words):
            if w.endswith(".") and len(w) > 2 and w[:-1].lower() not in TITLES:
                words[i], marks[i] = w[:-1], (marks[i][0], marks[i][1] - 1)
        for i in range(size):
            if words[i] == "," or words[i].lower() in PARTICLES and words[i].islower():
                continue
            title = is_title(words[i])
            for j in range(i + 1, min(size, i + 6)):
                if text[marks[j - 1][1]] == "." and words[j - 1].lower() not in TITLES and len(words[j - 1]) > 2:
                    break
                if words[j] == "," or words[j].islower() or words[j].endswith("."):
                    continue
                inner = words[i : j + 1]
                if inner.count(",") > 1 or "," in inner and (title or len(inner) > 5):
                    break
                if len(words[j]) < 2 and not words[j].isalpha():
                    continue
                known = any(w.lower().split("-")[0] in lexicon for w in inner)
                tail = _TAIL.match(text, marks[j][1]) if "," in inner else None
                before = i > 0 and words[i - 1] != "," and (text[marks[i - 1][1]] != "." or len(words[i - 1]) < 3)
                behind = j < size - 1 and words[j + 1] != "," and text[marks[j][1]] != "."
                yield marks[i][0], tail.end() if tail and text[tail.end() - 2].isupper() else marks[j][1], inner, before, behind, known
    for a, b in given:
        if a and (low[a - 1].isalnum() or low[a - 1] in "_@.-/'’+") and text[a - 1] != "'" and not (a > 1 and low[a - 1] == "." and low[a - 2].isspace()) or b < len(low) and (low[b].isalnum() or low[b] in "_@/’'+"):
            continue
        raised = text[a].isupper()
        if (m := _AFTER.match(text, b)) and m.group("sur")[0].isupper() == raised:
            yield a, m.end(), _IN_RUN.findall(text[a : m.end()]), False, False, True
        if (m := _BEFORE.search(text, max(0, a - 60), a)) and m.group("sur")[-1].isalpha() and (m.group("sur").split()[-1][0].isupper() == raised):
            tail = _TAIL.match(text, b)
            end = tail.end() if tail and text[tail.end() - 2].isupper() == raised else b
            yield m.start("sur"), end, _IN_RUN.findall(text[m.start("sur") : end]), False, False, True
    for m in FIELD.finditer(text):
        if not m.group("n").isupper():
            words = _IN_RUN.findall(m.group("n"))
            yield m.start("n"), m.end("n"), words, False, False, any(w in lexicon for w in words)
    for m in _LOWER_INITIAL.finditer(text):
        a = m.start() - 1
        if a >= 0 and text[a].isalpha() and text[a].islower() and (a == 0 or text[a - 1] in " \t\n\"|:," + CUT):
            yield a, m.end(), _IN_RUN.findall(text[a : m.end()]), False, False, False


def load() -> tuple[np.ndarray, float]:
    """The trained weights beside this module, also out of a zip."""
    with np.load(io.BytesIO(resources.files(__package__).joinpath(MODEL).read_bytes())) as f:
        return f["weights"].astype(np.float32), float(f["threshold"])
