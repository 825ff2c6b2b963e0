"""Training of the name tagger, in numpy, on texts whose names are known by their form, and on invented sentences.

Positives are spans around known given names, forms of address and initials (what ``seeded`` finds in the texts), negatives
all other spans of those texts. Most names are then replaced by invented ones (syllables in several scripts, or words that
the vocabulary of a public tokenizer has with a capital only), so that the weights of contexts, shapes and letters carry
the decision and not the names of the texts; words that the vocabularies have in lower case are the negatives' filling.
A share of the vocabulary (``held_out``) is never used.

    python -m lorebase.llm.names_training --texts FOLDER [FOLDER ...] --tokenizers FOLDER --out names_model.npz
"""

from __future__ import annotations

import argparse
import base64
import json
import re
from collections import Counter

import numpy as np
import xxhash

from lorebase.llm import names
from lorebase.llm.names import BUCKETS, TITLES, features, parts

MOST = 120_000  # spans of the texts that are used, the first in the order of a hash
ROUNDS = 6
THRESHOLD = -1.9  # chosen on names kept out of the training and on clean phrases: recall 0.95, 2 of 63 phrases marked

# sentences with a person (N) or another capitalised thing (O), written for this training
PERSON = """met with N about the rollout|N asked for a copy of the report|please contact N before Friday|Dear N,|thanks to N for the review|approved by N|written by N in March|Regards,\nN|N said that the test failed
interview with N, second round|the patient N was seen today|N and N agreed on it|N, the new lead, wrote back|I spoke to N yesterday|call N tomorrow|signed, N|Author: N|Contact: N|Attendees: N, N, N|Name: N|cc N|customer: N
according to N, it works|N's laptop was lost|reported by N on Monday|ask N whether it holds|N joined the team|N lives in Leeds|N was born in 1970|it was N who found it|yesterday N called twice|today N wrote|our manager N resigned|said N.|Sincerely, N
Caller | N | open|{"name": "N", "age": 3}|"owner": "N"|Speaker 2 is N.|Hi N,|Hello N!|from N to N|by N|with N|for N:|via N|Best, N|- N: will check|* N (chair)|@ N|1. N|N <x@y.example>|N (author)|N:|my wife N and I|son of N|sent by N
ich sprach mit N darüber|Herzliche Grüße\nN|laut N ist es fertig|Sehr geehrte Frau N,|N hat angerufen|von N geschrieben|Teilnehmer: N, N|gestern sagte N|j'ai parlé avec N hier|selon N c'est fini|N a appelé|rédigé par N|Cordialement,\nN|Cher N,
hablé con N ayer|según N ya está|N llamó dos veces|firmado: N|Saludos,\nN|Estimado N,|escrito por N|встретился с N вчера|сообщил N|N позвонил утром|мы говорили с N об этом|μίλησα με τον N χθες|N was promoted|hired N as an analyst|N won the prize
the invoice was paid by N|N and his wife moved|N is on leave|a letter from N arrived|N, aged 40, was injured|we thank N|Witness: N|Driver: N|professor N teaches here|the winner is N|emailed N again|N has not replied|as N pointed out|N will present|N et al.""".replace("\n", "|").replace("\\n", "\n")
OTHER = """the O is out of date|see O for details|we moved it to O|in O|at O|from O to O|O is a city|the O runs on port 80|O Inc. reported|the O committee met|open the O page|# O|## O|- O|O: see below|the New O|O Street|University of O|Bank of O|O University|O Ltd|the O team
restart O first|install O|O v2 was released|powered by O|based on O|using O|with O enabled|Chapter O|Table O|under O Settings|click O|press O|the city of O|flew to O|lives in O|based in O, O|north of O|O and O are products|O Conference|O Act|the O Theorem|Lake O|Mount O|Port O
die O ist veraltet|in O liegt|der O läuft|nach O fahren|la O est en panne|à O|dans O|el O no funciona|en O|desde O|O Days|Happy O|O Corporation|O Group|O Hotel|St. O Church|O Airport|O River|O County|the O Times|the O Museum|O National Park|O Street Station
Title: O|Topic: O|Subject: O|Component: O|Product: O|Status: O|Step: O|State: O|{"title": "O"}|"city": "O"|"status": "O"|Location | O | open|Project O|Operation O|Windows O|O Edition|O Server|O Cloud|O Database|the O Bridge|the O Party|O Airlines|O League|visit O|made in O
South O won|Northern O and Wales|Santa O is sunny|Cape O|San O|Los O|Saint O|Fort O|East O voted|West O|Upper O|Great O|Republic of O|North O and South O|North O|El O|New O is large|O City|O Island|Costa O|Puerto O|Hong O|O Valley|O Kernel|O Framework
the O Project|O Checklist|O Notes|About O|Introduction to O|How O Works|O Overview|O Guide|Understanding O|O and its limits|The O|A O|This O|Our O|Every O|each O|any O|no O|our O|this O|some O|every O|O API|O SDK|O Model|Phase O|O was founded in 1990|O shares fell""".replace("\n", "|").replace("\\n", "\n")
#: small caps on what a template says; the vocabulary fills the rest
ENDINGS = "son sen ov ova ev enko ski ska berg mann er stein dottir ez es i o a u an en ian wala ram oglu is os ou ides poulos elli etti ini ard eau ique vic vich ic escu eanu uk ko ang ing ong ung ua ao ei ai im ek ak".split()
CONSONANTS = "b bh br c ch d dr f g gh gr h j k kh kr l ll m mb n nd ng ny p ph pr q r s sh st t th tr ts v w x y z zh".split()
VOWELS = "a a a e e i i o o u ai ao ei ia ie oa ou ö ü é á ó í ã ø å ı".split()
CYRILLIC = dict(zip("abvgdeziklmnoprstufhcyjxwq", ["а", "б", "в", "г", "д", "е", "з", "и", "к", "л", "м", "н", "о", "п", "р", "с", "т", "у", "ф", "х", "ц", "ы", "й", "кс", "в", "к"]))
GREEK = dict(zip("abvgdeziklmnoprstufhcyjxwq", "αββγδεζικλμνοπρστυφχκυιξωκ"))

#: words before a name in the texts of this project; what stands there may be in any case
CUES = ("speaker 1 is", "speaker 2 is", "speaker 3 is", "patient", "attendees:", "attendee:", "interview with", "approved by", "signed,", "signed by", "met with", "thanks to", "complaint of", "customer:", "gesprächspartner:", "participants:", "dear", "it was", "owner |", "user |", "caller |", "contact |", '"caller": "', '"name": "', '"customer": "', '"owner": "', '"contact": "', "reported by", "asistentes:", "interlocuteur :", "rédigé par", "unterzeichnet:", "firmado:")
#: words that stand beside a given name, a title or an initial in these texts without being a surname
COMMON = frozenset("""hi hello hey dear thanks thank regards best cheers greetings saludos hola grüße gruß hallo liebe lieber bonjour salut merci
cordialement yes no ok okay please and""".split())
CAPITALS = frozenset("""redis query hybrid golden main state chunk planner loader street avenue road cluster set graph box search rewriter version
keep note call measured nobody open once prefer since do our each with measure step table chapter route budget order latency""".split())
PARTICLE = r"(?:(?:de la|de los|de las|van der|van den|von der|vom|von|van|del|dos|das|da|de|di|du|el|al|la|le|bin|ibn|ten|ter|zu)[ \t]+)"
_CAP = r"[A-ZÀ-ÖØ-ÞĀŁŚŠŽČ][^\W\d_]*(?:['’][A-ZÀ-ÖØ-Þ]?[^\W\d_]+)?(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)*"
_ANY = r"[^\W\d_]{3,}(?:['’][^\W\d_]+)?(?:-[^\W\d_]{3,})*"
AFTER_GIVEN = re.compile(rf"(?:-[^\W\d_]+)?[ \t]+(?:[^\W\d_]\.[ \t]*)?(?:{PARTICLE}?)(?P<sur>{_ANY})", re.I)
AFTER_TITLE = re.compile(rf"\.?[ \t]+(?:[A-Z]\.[ \t]*)*(?:{PARTICLE}?)(?P<sur>{_CAP})")
BEFORE_GIVEN = re.compile(rf"(?P<sur>(?:{PARTICLE})?{_ANY}),[ \t]+$", re.I)
INITIAL = re.compile(rf"(?<![\w.'’])[A-ZÀ-Ö]\.(?:[ \t]?[A-Z]\.)*[ \t]+(?:{PARTICLE}?)(?P<sur>{_CAP})")
LOWER_INITIAL = re.compile(rf"[^\W\d_]\.[ \t]+(?:{PARTICLE}?)(?P<sur>{_ANY})", re.I)


class Seeds:
    """Names that their form gives away: what the tagger is first taught with."""

    def __init__(self, given: frozenset[str]):
        import ahocorasick

        from lorebase.llm.personal import COMMON as WORDS

        self.given, self.not_names = given, WORDS | COMMON
        uses: dict[str, list[str]] = {}
        for kind, group in (("given", given), ("title", [t for t in TITLES if len(t) > 1]), ("cue", CUES)):
            for w in group:
                uses.setdefault(w, []).append(kind)
        self.auto = ahocorasick.Automaton()
        for w, kinds in uses.items():
            self.auto.add_word(w, (len(w), kinds))
        self.auto.make_automaton()

    def family(self, sur: str) -> bool:
        return len(sur) > 2 and sur.lower() not in self.not_names and sur.lower() not in CAPITALS

    def places(self, low: str, kind: str = "given") -> list[tuple[int, int]]:
        return [(end - size + 1, end + 1) for end, (size, kinds) in self.auto.iter(low) if kind in kinds]

    def __call__(self, text: str) -> list[tuple[int, int]]:
        low = text.lower() if len(text.lower()) == len(text) else text
        found = []
        alone = lambda a, b: not (a and (low[a - 1].isalnum() or low[a - 1] in "_@.-/'’+") or b < len(low) and (low[b].isalnum() or low[b] in "_@/"))
        for a, b in self.places(low):
            if not alone(a, b):
                continue
            raised = text[a].isupper()
            after, before = AFTER_GIVEN.match(text, b), BEFORE_GIVEN.search(text, max(0, a - 40), a)
            if after and after.group("sur").lower() not in self.not_names and after.group("sur")[0].isupper() == raised and (self.family(after.group("sur")) if raised else len(after.group("sur")) > 3):
                found.append((a, after.end()))
            elif before and (sur := before.group("sur").split()[-1]).lower() not in self.not_names | self.given and len(sur) > 3 and sur[0].isupper() == raised:
                tail = re.compile(r"[ \t]+[A-Z]\.").match(text, b)
                found.append((before.start("sur"), tail.end() if tail else b))
        for a, b in self.places(low, "title"):
            if alone(a, b) and text[a].isupper() and (m := AFTER_TITLE.match(text, b)) and self.family(m.group("sur")):
                more = AFTER_GIVEN.match(text, m.end()) if m.group("sur").lower() in self.given else None
                found.append((a, more.end() if more and self.family(more.group("sur")) else m.end()))
        found += [m.span() for m in INITIAL.finditer(text) if self.family(m.group("sur")) and m.group("sur") != "Box"]
        for _, b in self.places(low, "cue"):
            at = b + len(text[b : b + 3]) - len(text[b : b + 3].lstrip(" \t"))
            if (m := LOWER_INITIAL.match(text, at)) and m.group("sur").lower() not in self.not_names:
                found.append(m.span())
        return names.apart(found)



def held_out(word: str) -> bool:
    return xxhash.xxh32_intdigest(word.lower()) % 5 == 0


def vocabulary(folder: str) -> tuple[list[str], list[str]]:
    """(words in lower case of two public vocabularies, words that the first has with a capital only)."""
    with open(f"{folder}/byte_bpe_50k.json", encoding="utf-8") as f:
        words = [w[1:] for w in json.load(f)["model"]["vocab"] if re.fullmatch(r"Ġ[A-Za-z]{3,}", w)]
    with open(f"{folder}/byte_bpe_multi_50k.tiktoken", "rb") as f:
        more = [base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in f if line.strip()]
    low = {w for w in words if w.islower()} | {w[1:] for w in more if re.fullmatch(r" [^\W\d_]{3,}", w) and w.islower()}
    return sorted(w for w in low if not held_out(w)), sorted(w for w in words if w.istitle() and w.lower() not in low and not held_out(w))


def ordinary_words(texts: list[str], common: list[str], names_: set[str], least: int = 3) -> list[str]:
    """The vocabulary's words and those that the texts have in lower case several times, without names."""
    seen = Counter(w for t in texts for w in set(re.findall(r"(?<![^\s(])[^\W\d_]{3,}", t)) if w.islower())
    return sorted({*common, *(w for w, n in seen.items() if n >= least and not held_out(w))} - names_)


class Names:
    """Invented names."""

    def __init__(self, capital: list[str], common: list[str], given: frozenset[str], seed: int = 0):
        self.rng, self.capital, self.common = np.random.default_rng(seed), capital, common
        self.things = [w for w in capital if w.lower() not in given]

    def pick(self, of):
        return of[int(self.rng.integers(len(of)))]

    def syllables(self, n: int) -> str:
        return "".join(self.pick(CONSONANTS) + self.pick(VOWELS) for _ in range(n))

    def word(self, last: bool) -> str:
        kind = self.rng.random()
        if kind < 0.45:
            return self.pick(self.capital)
        if last and kind < 0.53:
            return self.pick(self.common).capitalize()
        stem = self.pick(["", "", self.pick(VOWELS)]) + self.syllables(int(self.rng.integers(1, 3)))
        return (stem + (self.pick(ENDINGS) if self.rng.random() < 0.6 else self.pick(["", "n", "r", "l", "m", "ng", "sh"]))).capitalize()

    def full(self, script: str = "LATIN", given: str | None = None, form: str = "") -> str:
        first, last = given or self.word(False), self.word(True)
        r = self.rng.random()
        if r < 0.14:
            last += "-" + self.word(True)
        out = f"{first} {last}"
        if r > 0.95:
            out = f"{first} {self.pick(['de', 'van', 'von', 'al', 'de la', 'bin', 'dos'])} {last}"
        elif r > 0.88:
            out = f"{first} {self.pick('ABCDEGHJKLMNPRST')}. {last}"
        elif r > 0.84:
            out = f"{self.pick('ABCDEGHJKLMNPRST')}. {last}"
        elif r > 0.76:
            out = f"{self.pick(['Dr.', 'Mr', 'Mrs', 'Mr.', 'Ms.', 'Prof.', 'Herr', 'Frau', 'Mme', 'Señora'])} {last}"
        elif r > 0.72:
            out = f"{last}, {first}"
        elif r > 0.67:
            out = f"{first} {self.word(False)} {last}"
        if script != "LATIN":
            table = CYRILLIC if script == "CYRILLIC" else GREEK
            out = "".join(table.get(c, table.get(c.lower(), c).capitalize() if c.isupper() else "") if c.isalpha() else c for c in _plain(out))
        return out.upper() if form == "upper" else out.lower() if form == "lower" else out

    def other(self) -> str:
        r = self.rng.random()
        word = lambda: self.pick(self.things if self.rng.random() < 0.35 else self.common)
        if r < 0.25:
            return self.pick(self.things) + (" " + self.pick(self.things) if r < 0.12 else "")
        return " ".join(word().capitalize() for _ in range(int(self.rng.integers(1, 4))))


def _plain(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("ø", "o").replace("ı", "i")


def spans_of(text: str, given: frozenset[str], find, level) -> list[tuple[int, int, list[tuple[str, str]]]]:
    """(start, end, features) of the candidates of a text."""
    low = text.lower() if len(text.lower()) == len(text) else text
    return [(a, b, features(text, a, b, *rest, level)) for a, b, *rest in names.candidates(text, low, find(low), given)]


def examples(texts: list[str], seeded, given: frozenset[str], find, level, common: list[str], capital: list[str], invented: int, seed: int = 0) -> tuple[list[list[tuple[str, str]]], np.ndarray, np.ndarray]:
    """(features, labels, weights). ``seeded(text)``: the names known by form; ``find(low)``: the known given names in it."""
    make = Names(capital, common, given, seed)
    rng = make.rng
    rows, y, weight = [], [], []

    def add(text: str, true: set[tuple[int, int]], w: float) -> None:
        for a, b, f in spans_of(text, given, find, level):
            hit = (a, b) in true
            part = not hit and any(a < d and c < b for c, d in true)  # it competes with the name and need not be far below 0
            rows.append(f), y.append(hit), weight.append(w / 5 if part else w)

    order = sorted(range(len(texts)), key=lambda i: xxhash.xxh64_intdigest(texts[i][:200], seed))
    for i in order:
        if len(rows) > MOST:
            break
        text = texts[i]
        true = seeded(text)
        if not true and rng.random() < 0.9:
            continue
        add(text, set(true), 4.0)
        for a, b in true:  # the same context with other names
            part = text[max(0, a - 80) : a], text[a:b], text[b : b + 60]
            form = "upper" if part[1].isupper() else "lower" if part[1].islower() else ""
            for _ in range(2):
                if form == "lower" and not any(w in given for w in part[1].split()):
                    continue
                new = make.full("CYRILLIC" if rng.random() < 0.12 else "GREEK" if rng.random() < 0.03 else "LATIN", form=form)
                if re.match(r"[A-ZÀ-Þ][a-z]*\.? ", part[1]) and part[1].split()[0].rstrip(".").lower() in TITLES:
                    new = f"{part[1].split()[0]} {make.word(True)}"
                add(part[0] + new + part[2], {(len(part[0]), len(part[0]) + len(new))}, 1.0)
    lexicon = sorted(given)
    persons, others = PERSON.split("|"), OTHER.split("|")
    starts = ["", "", "", "", "", "", "", "Today ", "We know that ", "- ", "Note: ", "\n", "The log is old. ", "In March ", "However, ", "Yesterday ", "So ", "When we were done, "]
    for _ in range(invented):
        frame, true = make.pick(starts) + make.pick(persons if rng.random() < 0.5 else others), set()
        if frame[:1].islower() and rng.random() < 0.5:
            frame = frame[0].upper() + frame[1:]
        script = "CYRILLIC" if re.search("[а-я]", frame) else "GREEK" if re.search("[α-ω]", frame) else "LATIN" if rng.random() < 0.88 else "CYRILLIC" if rng.random() < 0.75 else "GREEK"
        text = ""
        for piece in re.split(r"(\b[NO]\b)", frame):
            if piece == "N":
                known = make.pick(lexicon).capitalize() if rng.random() < 0.25 else None
                name = make.full(script, known, "upper" if rng.random() < 0.04 else "")
                true.add((len(text), len(text) + len(name)))
                text += name
            elif piece == "O":
                text += make.other()
            else:
                text += piece
        text += make.pick(["", "", ".", " and went on.", ", then stopped.", "\n", " We moved it.", " The log is old.", " " + make.pick(common).capitalize() + " it again."])
        add(text, true, 1.0)
    return rows, np.array(y, float), np.array(weight)


def fit(rows: list[list[tuple[str, str]]], y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, rate: float = 0.15, decay: float = 2e-6, batch: int = 512, seed: int = 0) -> np.ndarray:
    """Logistic regression over the hashed features by Adagrad; the span's own words, or what they are made of, are left out at random."""
    rng = np.random.default_rng(seed)
    cache: dict[tuple[str, str], list[tuple[int, float]]] = {}
    flat, factors, ends, identity = [], [], [0], []
    for found in rows:
        for f in found:
            own = cache.get(f)
            if own is None:
                own = cache[f] = parts(*f)
            flat += [r for r, _ in own]
            factors += [x for _, x in own]
            identity += [2 if f[0] != "=" and k < 2 else 1 if f[0] != "=" or f[1].startswith("given") else 0 for k in range(len(own))]
        ends.append(len(flat))
    flat, factors, identity, ends = np.array(flat, np.int32), np.array(factors, np.float32), np.array(identity), np.array(ends)
    w, g2 = np.zeros(2 * BUCKETS, np.float32), np.full(2 * BUCKETS, 1e-2, np.float32)
    for n in range(rounds):
        order = rng.permutation(len(rows))
        loss = 0.0
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            size = ends[some + 1] - ends[some]
            where = np.repeat(ends[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            who = np.repeat(np.arange(len(some)), size)
            x = factors[where] * (identity[where] < np.where(rng.random(len(some)) < 0.15, 1, np.where(rng.random(len(some)) < 0.4, 2, 3))[who])
            s = np.bincount(who, w[flat[where]] * x, len(some))
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            loss += float((weight[some] * -np.log(np.where(y[some] > 0.5, p, 1 - p) + 1e-9)).sum())
            d = (weight[some] * (p - y[some])).astype(np.float32)
            grad = np.bincount(flat[where], d[who] * x, 2 * BUCKETS).astype(np.float32)
            used = grad != 0
            g2[used] += grad[used] ** 2
            w[used] -= rate * grad[used] / np.sqrt(g2[used]) + decay * w[used]
        print(f"round {n + 1}: loss {loss / weight.sum():.4f}", flush=True)
    return w


def texts_in(folder: str) -> list[str]:
    import pyarrow.parquet as pq

    out: list[str] = []
    for table, column in (("pages", "content"), ("session_events", "content"), ("issues", "description"), ("notes", "body")):
        out += [t for t in pq.read_table(f"{folder}/{table}.parquet", columns=[column])[column].to_pylist() if t]
    comments = pq.read_table(f"{folder}/issues.parquet", columns=["comments"])["comments"].to_pylist()
    return out + [n["body"] for c in comments if c and c["nodes"] for n in c["nodes"] if n and n["body"]]


def decoded(texts: list[str]) -> list[str]:
    """The texts, those that are JSON by their strings."""
    from lorebase.llm.personal import literals

    out = []
    for t in texts:
        found = literals(t)
        out += [t] if found is None else [head + inner for _, _, head, inner in found]
    return [t for t in out if len(t) > 3]


def main() -> None:
    from lorebase.llm.personal import FEMALE, MALE

    cli = argparse.ArgumentParser()
    cli.add_argument("--texts", nargs="+", required=True)
    cli.add_argument("--tokenizers", required=True)
    cli.add_argument("--out", required=True)
    cli.add_argument("--invented", type=int, default=150_000)
    cli.add_argument("--exclude", help="a file with words that must not be used, one in a line")
    args = cli.parse_args()
    common, capital = vocabulary(args.tokenizers)
    if args.exclude:
        banned = set(open(args.exclude, encoding="utf-8").read().lower().split())
        common, capital = [w for w in common if w not in banned], [w for w in capital if w.lower() not in banned]
    seeds = Seeds(frozenset(FEMALE + MALE))
    texts = decoded([t for folder in args.texts for t in texts_in(folder)])
    found = {w.lower() for t in texts for a, b in seeds(t) for w in re.findall(r"[^\W\d_]+", t[a:b])}
    ordinary = ordinary_words(texts, common, found)
    make = Names(capital, common, seeds.given, 1)
    unusual = [*(w.lower() for w in capital), *(make.word(k % 2 > 0).lower() for k in range(20_000))]
    y = np.array([1.0] * len(ordinary) + [0.0] * len(unusual))
    first = fit([[("word", w)] for w in [*ordinary, *unusual]], y, np.ones(len(y)), rounds=12)
    print(f"{len(ordinary)} ordinary words, {len(unusual)} others")
    rows, y, weight = examples(texts, seeds, seeds.given, seeds.places, names.Tagger(seeds.given, first).level, common, capital, args.invented)
    print(f"{len(rows)} spans, {int(y.sum())} names")
    w = fit(rows, y, weight) + first
    np.savez_compressed(args.out, weights=w.astype(np.float16), threshold=THRESHOLD)


if __name__ == "__main__":
    main()
