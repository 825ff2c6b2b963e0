"""Personal information in free text: detection of typed items and keyed surrogates.

One pass of a keyword automaton over a text says which rules can apply at all and where; only these regular expressions
run, and only there. Items found: email, phone, id_number, address, name; names are found by the trained tagger of ``names``.

Surrogates: each item is replaced by another of its type, script and format, drawn with a secret key. Digits and letters
of numbers, mail boxes and hosts are permuted by a keyed Feistel network over strings of the same format, initials by a
keyed cycle of the alphabet; given names go along a keyed cycle of the names of their gender, surnames and words of addresses
become syllables of their script that spell a keyed permutation of them. Every one of these maps is injective and depends on the item alone:
equal items get equal surrogates and different items different ones, in every row.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.names import CUT, PARTICLES, TITLES, Tagger, apart

KINDS = ("email", "phone", "id_number", "address", "name")
_ORDER = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}  # which kind keeps a span that two claim
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

FEMALE = """ada agnes alice amara amelia amina ana anna anne astrid aveline beatriz camille carla carmen caroline catherine
charlotte chiara claire clara daniela diana elena elisa elizabeth emily emma esther eva fatima fiona frida giulia grace greta
hanna heidi helen helena ida ilse imani ines ingrid irene isabel jana jane julia karin katarina kristina laura leila lena linda
lucia lucía lucy maria mariam marie marta mary maëlle maelle mireia monica nadia naomi natalia nina noor nora olga olivia olwen
patricia paula petra priya rachel renske rosa rosalind ruth sanna sara sarah sofia sophie susan teresa thandi ulrike ursula
valentina vera wanda xenia yasmin yuna zelda zoe""".split()
MALE = """adam ahmed alan albert alejandro alexander ali anders andré andre andrew anton antonio arthur ben björn bjorn boris
carlos charles chidi christian daniel david diego dmitri edward edwin emil enrique erik ernesto felix fernando francisco frank
george giovanni hamid hans hassan henrik henry hugo ibrahim igor ivan jack jakob james jan javier johannes john jonas jorge josé
juan karl kofi lars leon louis lucas luis magnus manuel marco mark martin matteo michael miguel mohamed nikolai nils oliver omar
oriol oscar pablo patrick paul pedro peter philip pierre piet quentin rafael rafi ricardo robert samuel sergei simon stefan
stephen søren soren thomas tobias tomas victor viggo walter werner william yusuf""".split()
# words that follow a given name without being a surname, or stand where a surname would
COMMON = set("""a about after again all already also although always am an and any are as ask asked asks at be because been before
being but by call called calls can cannot cc check checked checks come could cut did do does done draft each either every few for
found from gave get gets give given gives go goes got had has have he held her here his how i if in into is it its just keep keeps
know last like look looked loop made make makes map may me more most must my need needs never new next no not note now of off often
on once one only or other our out over own page pass patterns please put ran read reads run said same saw say says see seems sent set
she should since so some soon still such take takes than that the their them then there these they this those though through time to
told took too trace two under until up upon us use used uses version via want wants was we went were what when where whether which
while who whose why will with within without would writes wrote yet you your und oder aber et ou mais y o pero""".split())
_TLD = r"[A-Za-z]{2,24}"
_AT = r"(?:[@＠]|[ \t]{1,2}[@＠][ \t]{1,2}|[ \t]{0,2}[\[({<][ \t]?(?:at|ät|arroba|chez)[ \t]?[\])}>][ \t]{0,2})"
_DOT = r"(?:\.|[ \t]?[\[({<][ \t]?(?:dot|punkt|punto|point)[ \t]?[\])}>][ \t]?|[ \t](?:dot|punkt|punto|point)[ \t])"
EMAIL = re.compile(rf"(?<![\w.@/:+-])(?:mailto:)?(?P<box>[A-Za-zÀ-ÿ0-9][\w.+'-]{{0,63}}){_AT}(?P<host>[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}{_TLD})(?![\w@]|:[\w~/.])", re.I)
EMAIL_WORDS = re.compile(rf"(?<![\w.@/:+-])(?:mailto:)?(?P<box>[A-Za-z0-9][\w.+'-]{{1,63}})[ \t]+(?:at|arroba)[ \t]+(?P<host>[A-Za-z0-9-]+(?:[ \t](?:dot|punkt|punto|point)[ \t][A-Za-z0-9-]+)+)(?!\w)", re.I)

# the first character stands before the look behind it, so that the search can skip to it
NUMBER = re.compile(r"[+(\d](?<![\w.,:/@#-].)(?:(?<=\()\+?\d|(?<=\+)\d|(?<=\d))[\d \t()./\u00a0-]{5,24}\d(?:[ \t]*(?:ext\.?|x|Durchwahl|poste)[ \t]*\d{1,5})?(?![\w@])(?![.,:/-]\d)")
_PHONES = [
    r"\+[1-9][\d \t()./\u00a0-]{7,20}\d",
    r"00[1-9]\d[ \t./-][\d \t()./-]{6,16}\d",
    r"(?:1[ .-])?\(?[2-9]\d\d\)?[ .-]{1,2}\d{3}[ .-]\d{4}",
    r"\(?0[1-9]\d{0,4}\)?(?:[ \t]?[ ./-][ \t]?\d{2,8}){1,4}",
]
PHONE = re.compile(rf"(?:{'|'.join(_PHONES)})(?:[ \t]*(?:ext\.?|x|Durchwahl|poste)[ \t]*\d{{1,5}})?$", re.I)
PHONE_CUE = re.compile(r"\b(?:phone|tel\.?|tél\.?|mobile?|cell|fax|whatsapp|call|handy|telefon|téléphone|teléfono|móvil|portable|notruf|callback|reach (?:me|her|him|us) (?:on|at))(?![^\W\d_])[^\d\n.!?\x1e]{0,18}$", re.I)
_BARE_DATE = re.compile(r"(?:19|20)\d\d([-/.])\d{1,2}\1\d{1,2}(?!\d)|\d{1,2}([-/.])\d{1,2}\2(?:19|20)\d\d(?!\d)")

ID_WORDS = ("ssn", "social security", "social", "tax id", "tax number", "taxpayer", "tin", "ni number", "nino", "national insurance", "passport", "passeport", "pasaporte", "reisepass", "national id", "id card", "identity card", "ausweisnummer", "personalausweis", "ausweis", "personal number", "personnummer", "licence", "license", "permis de conduire", "führerschein", "permiso de conducir", "dni", "nif", "nie", "cpr", "nir", "sécurité sociale", "seguridad social", "sozialversicherung", "rentenversicherung", "steuer-id", "steuernummer", "steuer-identifikationsnummer", "carte d'identité", "codice fiscale", "bsn", "curp", "cpf", "pesel", "aadhaar")
ID_AFTER = re.compile(
    r"(?:[ \t]*(?:card|number|no\.?|nr\.?|nº|n°|num\.?|numéro|número|nummer|id|code|security number|is|was|lautet|es|est|:|=|#|\"|'|\\|\(|\[|\||-|,)){0,7}[ \t]*"
    r"(?P<id>(?:[A-Z]{1,3}[ -]?)?\d[\dA-Z]*(?:[ ./-]\d[\dA-Z]*){0,5}(?:[ -]?[A-Z](?![A-Za-z]))?)", re.I)  # fmt: skip
ID_SHAPES = re.compile(r"[\dA-Z](?<![\w.-].)(?:(?<=\d)\d\d(?<!000)(?<!666)-(?!00)\d{2}-(?!0000)\d{4}|(?<=[A-CEGHJ-PR-TW-Z])[A-CEGHJ-PR-TW-Z][ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]|(?<=\d)\d{7}-[A-HJ-NP-TV-Z]|(?<=Z)[A-Z]-\d{3}-\d{4}-\d{2})(?![\w-])")

_NAMED = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_STREET = r"(?:street|road|lane|avenue|ave|drive|boulevard|blvd|rd|court|crescent|terrace|square|close|way|row|gardens|mews|parkway|highway)"
ADDRESSES = {
    "en": re.compile(rf"(?<![\w.-])(?:(?:flat|suite|apt|apartment|unit)\.?[ \t]*\w{{1,5}},?[ \t]+)?\d{{1,5}}[a-z]?[ \t]+(?:[NSEW]\.?[ \t]+)?(?P<n>{_NAMED}(?:[ \t]{_NAMED})?)[ \t]+{_STREET}\b\.?(?:,[ \t]*(?:apt|apartment|unit)\.?[ \t]*\w{{1,5}})?", re.I),
    "fr": re.compile(rf"(?<![\w.-])\d{{1,5}}(?:[ \t]*(?:bis|ter|quater))?,?[ \t]+(?P<n>(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours)[ \t]+(?:(?:des?|du|de la|de l['’]|d['’]|la|le|les)[ \t]*)*(?-i:[A-ZÀ-Þ]){_NAMED})", re.I),
    "es": re.compile(rf"\b(?P<n>(?:calle|avenida|avda\.?|plaza|paseo|camino|carrer|c/(?=[ \t]))[ \t]*(?:(?:de|del|de la|las|los)[ \t]+)*{_NAMED}(?:[ \t]{_NAMED})?),?[ \t]*(?:n[º°.]?[ \t]*)?\d{{1,5}}\b(?:,[ \t]*\d{{1,2}}[ºª°][ \t]*\w)?", re.I),
    "de": re.compile(rf"\b(?P<n>{_NAMED}(?:[ \t]?str\.|stra(?:ß|ss)e|[ \t]stra(?:ß|ss)e|weg|platz|allee|gasse|ufer|damm))[ \t]+\d{{1,4}}(?:[ \t]?[a-z](?![a-z]))?\b", re.I),
    "box": re.compile(r"\b(?P<n>p\.?[ \t]?o\.?[ \t]?box|postfach|apartado(?:[ \t]de[ \t]correos)?|bo[iî]te postale|case postale|b\.?p\.?)[ \t]*(?:n[º°.]?[ \t]*)?\d{1,6}\b", re.I),
}
PLACE = re.compile(r",?[ \t]*\n?[ \t]*(?:(?:\d{5}|[A-Z]{2}[ \t]\d{5})[ \t]+)?[A-ZÀ-Þ][^\W\d_]{2,}(?:[- ][A-ZÀ-Þ][^\W\d_]+(?!\d))?(?:[ \t]+[A-Z]{1,2}\d{1,2}[ \t]\d[A-Z]{2})?(?:,[ \t]*[A-Z]{2}[ \t]\d{5})?")
TRIGGERS = {
    "en": (" street", " road", " lane", " avenue", " ave", " drive", " boulevard", " blvd", " rd", " court", " crescent", " terrace", " square", " close", " way", " row", " gardens", " mews", " parkway", " highway"),
    "fr": ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "allée ", "impasse ", "quai ", "route ", "cours "),
    "es": ("calle ", "avenida ", "avda", "plaza ", "paseo ", "camino ", "carrer ", "c/"),
    "de": ("str. ", "straße ", "strasse ", "weg ", "platz ", "allee ", "gasse ", "ufer ", "damm "),
    "box": ("o. box", "o box", "pobox", "postfach", "apartado", "te postale", "case postale", "bp ", "b.p. "),
}
_NOT_STREETS = COMMON | {"main", "mapped", "items", "percent", "ms", "rows", "tokens", "pages", "calls", "chunks", "files", "links", "minutes", "turns", "retries", "sessions", "labels"}


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Detector:
    def __init__(self, tagger: bool = True):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        words: dict[str, list[tuple[str, str]]] = {}
        for kind, group in (("given", FEMALE + MALE), ("id", ID_WORDS)):
            for w in group:
                words.setdefault(w, []).append((kind, w))
        for form, group in TRIGGERS.items():
            for w in group:
                words.setdefault(w, []).append((form, w))
        for w in ("@", "＠", "at]", "at)", "at}", "at>", " dot ", "arroba", " punkt ", " punto ", " point "):
            words.setdefault(w, []).append(("mail", w))
        for w, uses in words.items():
            self.auto.add_word(w, (len(w), uses))
        self.auto.make_automaton()
        self.given = frozenset(FEMALE) | frozenset(MALE)
        self.tagger = Tagger(self.given) if tagger else None

    def given_places(self, low: str) -> list[tuple[int, int]]:
        """Where known given names stand in a text in lower case."""
        return [(end - size + 1, end + 1) for end, (size, uses) in self.auto.iter(low) if any(kind == "given" for kind, _ in uses)]

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        """Items as (start, end, kind), ascending, not overlapping."""
        low = _lower(text)
        hits: dict[str, list[tuple[int, int, str]]] = {}
        for end, (size, uses) in self.auto.iter(low):
            for kind, word in uses:
                hits.setdefault(kind, []).append((end - size + 1, end + 1, word))
        found: list[tuple[int, int, str]] = []
        if "mail" in hits:
            found += self._emails(text, hits["mail"])
        found += self._ids(text, low, hits.get("id", ()))
        found += self._phones(text, found)
        for form in TRIGGERS:
            if form in hits:
                found += self._addresses(form, text, hits[form])
        if self.tagger:
            found += [(a, b, "name") for a, b in self.tagger.spans(text, low, [(a, b) for a, b, _ in hits.get("given", ())])]
        return apart(sorted(set(found), key=lambda x: (_ORDER[x[2]], x[0], -x[1])))

    @staticmethod
    def _emails(text: str, hits) -> Iterator[tuple[int, int, str]]:
        last = -1
        for start, end, word in hits:
            if start < last:
                continue
            low, high = max(0, start - 90), end + 400
            for rule in (EMAIL_WORDS,) if word.startswith(" ") or word == "arroba" else (EMAIL,):
                for m in rule.finditer(text, low, high):
                    box = m.group("box").lower()
                    after = text[m.end() : m.end() + 2]
                    if m.end() <= start or (box == "git" and after[:1] in ":/") or text[max(0, m.start() - 3) : m.start()].endswith("//"):
                        continue
                    last = max(last, m.end())
                    yield m.start(), m.end(), "email"

    @staticmethod
    def _ids(text: str, low: str, hits) -> Iterator[tuple[int, int, str]]:
        for start, end, _ in hits:
            if start and (low[start - 1].isalnum()) or end < len(low) and low[end].isalpha() and not low.startswith(("number", "nummer", "s ", "e"), end):
                continue
            m = ID_AFTER.match(text, end)
            if m and sum(c.isdigit() for c in m.group("id")) >= 6:
                lone = re.fullmatch(r"[\d .-]+([ -][A-Za-z])", m.group("id")) if " " in m.group("id") else None  # the next sentence's first letter
                yield m.start("id"), m.end("id") - (len(lone.group(1)) if lone else 0), "id_number"
        if len(text) > 8:
            for m in ID_SHAPES.finditer(text):
                yield m.start(), m.end(), "id_number"

    @staticmethod
    def _phones(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
        for m in NUMBER.finditer(text):
            a, b = m.span()
            body = m.group().rstrip(" \t(./-")
            b = a + len(body)
            if any(a < d and c < b for c, d, _ in taken):
                continue
            main = re.split(r"[ \t]*(?:ext|x|Durchwahl|poste)", body, maxsplit=1, flags=re.I)[0]
            digits = sum(c.isdigit() for c in main)
            if not 7 <= digits <= 15 or _BARE_DATE.match(body) or re.fullmatch(r"\d{6}-\d{4}", body):
                continue
            if PHONE.match(body) and (digits >= 9 or body[0] in "+("):
                yield a, b, "phone"
            elif digits >= 8 and PHONE_CUE.search(text, max(0, a - 40), a):
                yield a, b, "phone"

    @staticmethod
    def _around(text: str, start: int, end: int) -> tuple[int, int]:
        """A window of ten words, and of 70 characters at least, on either side; words are whole, whatever their length."""
        low, high, n = start, end, 0
        while low > 0 and (n < 10 or start - low < 70):
            blank = text.rfind(" ", 0, low - 1) + 1
            low, n = max(blank, text.rfind("\n", blank, low - 1) + 1), n + 1
        n = 0
        while high < len(text) and (n < 10 or high - end < 70):
            blank = text.find(" ", high + 1)
            line = text.find("\n", high + 1, blank if blank >= 0 else len(text))
            high, n = line if line >= 0 else blank if blank >= 0 else len(text), n + 1
        return low, high

    def _addresses(self, form: str, text: str, hits) -> Iterator[tuple[int, int, str]]:
        last = -1
        for start, end, _ in hits:
            if start < last:
                continue
            for m in ADDRESSES[form].finditer(text, *self._around(text, start, end)):
                if m.end() <= start:
                    continue
                name = m.group("n").split()
                if form == "fr" and name[0][0].isupper() and name[0].lower() != "rue" and not re.match(r"\d+(?:[ \t]*(?:bis|ter|quater))?,|\d+[ \t]*(?:bis|ter|quater)", m.group(), re.I):
                    continue
                if form == "en" and any(w.lower() in _NOT_STREETS for w in name):
                    continue
                if form == "en" and name[0].islower() and re.search(r"(?-i:[A-Z])\w*\.?$", m.group()):
                    continue
                stop = m.end()
                if tail := PLACE.match(text, stop):
                    first = re.search(r"[A-ZÀ-Þ][^\W\d_]+", tail.group())
                    if ("," in tail.group() or "\n" in tail.group() or re.search(r"\d{5}", tail.group())) and first and first.group().lower() not in COMMON:
                        stop = tail.end()
                last = max(last, stop)
                yield m.start(), stop, "address"


_LITERAL = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)"([ \t\r\n]*:)?', re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([\"\\/bfnrt]))")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_PLAIN_KEYS = {"text", "content", "body", "type", "thinking", "name", "command", "path", "file_path"}


def _unescape(text: str) -> str:
    return _unescaped(text)[0] if "\\" in text else text


def _unescaped(text: str) -> tuple[str, list[int]]:
    """The text without JSON escapes, and where each of its characters (and its end) stood."""
    out, places, at = [], [], 0
    for m in _ESCAPE.finditer(text):
        out.append(text[at : m.start()])
        places += range(at, m.start())
        out.append(chr(int(m.group(1), 16)) if m.group(1) else _ESCAPES.get(m.group(2), m.group(2)))
        places.append(m.start())
        at = m.end()
    out.append(text[at:])
    return "".join(out), [*places, *range(at, len(text) + 1)]


def literals(content: str) -> list[tuple[int, int, str, str]] | None:
    """(start, end, head, text) of each string value of a content that is JSON, without its quotes; else None.

    ``text`` is decoded; ``head`` is what a reader sees before it: its key, where the key says something.
    """
    if content.lstrip()[:1] not in ("[", "{"):
        return None
    try:
        if not isinstance(json.loads(content), (list, dict)):
            return None
    except (ValueError, RecursionError):
        return None
    out, key = [], ""
    for m in _LITERAL.finditer(content):
        if m.group(2):
            key = m.group(1)
        else:
            out.append((*m.span(1), f'"{key}": "' if key and key not in _PLAIN_KEYS else "", _unescape(m.group(1))))
            if content[m.end() : m.end() + 2].lstrip()[:1] != ",":
                key = ""
    return out


class Redactor:
    """Replaces the items of a content. ``mode``: ``surrogate`` or ``placeholder``."""

    def __init__(self, key: str, mode: str = "surrogate"):
        self.detect, self.key, self.mode = Detector(), key.encode(), mode
        self.cycles: dict[tuple, dict[str, str]] = {}

    def __call__(self, content: str) -> tuple[str, list[tuple[str, str]]]:
        """(content with its items replaced, [(kind, item)])."""
        new, items = self.replaced(content)
        return new, [(kind, item) for kind, item, _ in items]

    def replaced(self, content: str) -> tuple[str, list[tuple[str, str, str]]]:
        """(content with its items replaced, [(kind, item, surrogate)]); all else stays as it was written, character by character.

        The strings of JSON, damaged JSON too, are read without their escapes and written with them.
        """
        strings = literals(content)
        if strings is None:
            escaped = content.lstrip()[:2] in ("[{", '{"') and "\\" in content
            strings = [(0, len(content), "", _unescape(content))] if escaped else None
        if strings is None:
            return self._replaced(content, self.detect(content))
        # all strings are looked at in one go
        ends, joined = [], CUT.join([head + text for _, _, head, text in strings])
        for _, _, head, text in strings:
            ends.append((ends[-1] + len(CUT) if ends else 0) + len(head) + len(text))
        by_string: dict[int, list[tuple[int, int, str]]] = {}
        for x, y, kind in self.detect(joined):
            i = bisect_left(ends, y)
            shift = ends[i] - len(strings[i][3])
            if y > shift:
                by_string.setdefault(i, []).append((max(0, x - shift), y - shift, kind))
        out, at, items = [], 0, []
        for i, spans in sorted(by_string.items()):
            a, b, _, text = strings[i]
            raw, cut = content[a:b], 0
            places = _unescaped(raw)[1]
            for x, y, kind in spans:
                new, own = self._replaced(text[x:y], [(0, y - x, kind)])
                items += own
                out += [content[at : a + places[x]] if not cut else raw[cut : places[x]], json.dumps(new, ensure_ascii=False)[1:-1]]
                cut = places[y]
            at = a + cut
        return "".join(out) + content[at:], items

    def _replaced(self, text: str, spans: list[tuple[int, int, str]]) -> tuple[str, list[tuple[str, str, str]]]:
        """(text with its spans replaced, [(kind, item, what stands for it)])."""
        out, at, items = [], 0, []
        for a, b, kind in spans:
            item = text[a:b]
            new = PLACEHOLDER[kind] if self.mode == "placeholder" else self.surrogate(kind, item)
            items.append((kind, item, new))
            out += [text[at:a], new]
            at = b
        return "".join(out) + text[at:], items

    def surrogate(self, kind: str, item: str) -> str:
        if kind in ("phone", "id_number"):
            return self._format(kind, item)
        return self._email(item) if kind == "email" else self._address(item) if kind == "address" else self._name(item)

    def digest(self, kind: str, text: str) -> str:
        """A keyed digest of an item (or of a surrogate): equal for equal ones, however they are written."""
        return f"{kind}:{self._bits('item', kind, canonical(kind, text)):032x}"

    def _bits(self, *of: object) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, of)).encode("utf-8", "replace"), key=self.key[:64], digest_size=16).digest())

    def _rounds(self, a: int, b: int, left: int, right: int, tweak: tuple, back: bool = False) -> tuple[int, int]:
        """A keyed permutation of the pairs a < left, b < right; ``back``: its inverse."""
        for step in reversed(range(6)) if back else range(6):
            size, other = (right, a) if step % 2 else (left, b)
            add = 0
            for part in range(size.bit_length() // 128 + 1):
                add = add << 128 | self._bits("rounds", *tweak, step, part, f"{other:x}")
            if step % 2:
                b = (b - add if back else b + add) % right
            else:
                a = (a - add if back else a + add) % left
        return a, b

    def _next(self, c: str, alphabet: str | list[str], *tweak: object) -> str:
        """A keyed permutation of an alphabet or list, all its members in one cycle: none stays."""
        known = self.cycles.get(tweak)
        if known is None:
            order = sorted(alphabet, key=lambda x: self._bits("order", *tweak, x))
            known = self.cycles[tweak] = dict(zip(order, order[1:] + order[:1]))
        return known[c]

    def _moved(self, places: list[tuple[int, int]], *tweak: object) -> list[int]:
        """A keyed permutation of the tuples (value < radix) of given radices under which none stays, but for one tuple in all."""
        half = len(places) // 2
        left, right, a, b = 1, 1, 0, 0
        for i, (value, radix) in enumerate(places):
            if i < half:
                left, a = left * radix, a * radix + value
            else:
                right, b = right * radix, b * radix + value
        a, b = self._rounds(a, b, left, right, tweak)
        n = (a * right + b + 1) % (left * right)  # one step of the cycle that the permutation orders
        a, b = self._rounds(*divmod(n, right), left, right, tweak, back=True)
        n, out = a * right + b, []
        for _, radix in reversed(places):
            n, value = divmod(n, radix)
            out.append(value)
        return out[::-1]

    def _spelled(self, word: str, *tweak: object) -> str:
        """Another word of the same script, different ones for different words.

        Latin, Cyrillic and Greek words become syllables of their script: four at least, by the word's length more. Latin
        words with other letters than a-z end in é; words of more than LONG characters are known by a digest of 128 bits
        and end in s; what would be a given name ends in n. Words of a script in BLOCKS become as many of its characters.
        """
        block = next(((low, high) for low, high in BLOCKS if all(low <= ord(c) <= high for c in word)), None)
        if block and len(word) <= LONG:
            size = block[1] - block[0] + 1
            return "".join(chr(block[0] + v) for v in self._moved([(ord(c) - block[0], size) for c in word], "block", block[0], len(word), *tweak))
        script, first, size = next(((name, first, size) for name, first, size in ALPHABETS if all(first <= ord(c) < first + size for c in word)), ("LATIN", 0, 0))
        if len(word) > LONG:
            number, end = self._bits("long", *tweak, word), {"CYRILLIC": "с", "GREEK": "ς"}.get(script, "s")
        elif size:
            number, end = 0, ""
            for c in word:
                number = number * size + ord(c) - first + 1
        else:
            number, end = int.from_bytes(b"\x01" + word.encode("utf-8", "surrogatepass")), "é"
        size = max(4, -(-number.bit_length() // 6))
        half = 8**size
        a, b = self._rounds(*divmod(number, half), half, half, ("spelled", *tweak, script, end, size))
        new = _word(a * half + b, size, script) + end
        return new + "n" if new in self.detect.given else new

    def _alike(self, word: str, *tweak: object) -> str:
        """A permutation of the words with as many letters and digits; other ASCII characters stay at their places."""
        if not word.isascii() or len(word) > LONG:
            return self._spelled(word, *tweak) + ("" if word.isascii() else "ø")
        own = [c for c in word if c.isalnum()]
        if len(own) < 2:
            new = own and [self._next(own[0], _BASE36, "one", *tweak)]
        else:
            new = [_BASE36[v] for v in self._moved([(int(c, 36), 36) for c in own], "alike", len(own), *tweak)]
        figures = iter(new)
        return "".join(next(figures) if c.isalnum() else c for c in word)

    def _email(self, item: str) -> str:
        box, sep, host = re.match(rf"(?i)((?:mailto:)?.+?)({_AT}|[ \t]+(?:at|arroba)[ \t]+)(.*)", item, re.S).groups()
        head = "mailto:" if box.lower().startswith("mailto:") else ""
        box = box[len(head) :]
        new = self._alike(box.lower(), "box", canonical("email", item).rpartition("@")[2])
        tail = re.split(rf"({_DOT})", host, flags=re.I)
        tail[:-1:2] = [self._alike(label.lower(), "host") for label in tail[:-1:2]]
        return head + (new.upper() if box.isupper() else new) + sep + "".join(tail)

    def _format(self, kind: str, item: str) -> str:
        """Digits become digits and letters letters, all of a number together; separators, a phone's prefix and the length stay."""
        own = [c for c in item if c.isdecimal() or kind == "id_number" and "a" <= c.lower() <= "z"]
        keep = 0
        if kind == "phone":
            keep = 2 if "+" in item[:2] else 1 if own[:1] == ["0"] else 0
        form = "".join("0" if c.isdecimal() else "A" for c in own)
        places = [(int(c), 10) if c.isdecimal() else (ord(c.lower()) - 97, 26) for c in own[keep:]]
        tweak = (kind, form, "".join(own[:keep]))
        new = self._moved(places, *tweak) if len(places) > 1 else [(v + 1) % radix for v, radix in places]
        figures = iter([*own[:keep], *(str(v) if radix == 10 else _LETTERS[v] for v, (_, radix) in zip(new, places))])
        return "".join(_cased(next(figures), c) if c.isdecimal() or kind == "id_number" and "a" <= c.lower() <= "z" else c for c in item)

    def _address(self, item: str) -> str:
        fixed = set("street road lane avenue ave drive boulevard blvd rd court flat suite apt apartment unit rue calle place chemin bis ter str weg platz allee gasse strasse straße box postfach apartado de la du des p o n s e w".split())

        def swap(m: re.Match) -> str:
            w = m.group()
            if w.isdigit():
                return "".join(map(str, self._moved([(int(c), 10) for c in w], "house", len(w)))) if len(w) > 1 else w
            low = w.lower()
            if low in fixed or len(w) < 3:
                return w
            end = next((e for e in ("strasse", "straße", "weg", "platz", "allee", "gasse") if low.endswith(e)), "")
            return _cased(self._spelled(low.removesuffix(end), "street") + end, w)

        return re.sub(r"\d+|[^\W\d_]+", swap, item)

    def _name(self, item: str) -> str:
        tokens = re.split(r"([ \t,.-]+)", item)
        out = []
        for i, w in enumerate(tokens):
            low = w.lower()
            if i % 2 or not w or low in TITLES or low in PARTICLES:
                out.append(w)
            elif low in _LETTERS or low in _ACCENTED:
                out.append(_cased(self._next(low, _LETTERS if low in _LETTERS else _ACCENTED, "initial", low in _LETTERS), w))
            elif low in self.detect.given:
                gender = "f" if low in _FEMALE else "m"
                out.append(_cased(self._next(low, FEMALE if gender == "f" else MALE, "given", gender), w))
            else:
                out.append(_cased(self._spelled(canonical("name", w), "surname"), w))
        return "".join(out)


LONG = 64
_BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
_LETTERS, _ACCENTED = _BASE36[10:], "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
_SYLLABLES = {
    script: [c + v for c in consonants for v in vowels][:64]
    for script, consonants, vowels in (("LATIN", "bdfgklmnprstvz", "aeiou"), ("CYRILLIC", "бвгдзклмнпрст", "аеиоу"), ("GREEK", "βγδζθκλμνπρστ", "αεηιο"))
}
#: script, first letter and count of the small letters by which words are numbered
ALPHABETS = (("LATIN", ord("a"), 26), ("CYRILLIC", 0x430, 0x30), ("GREEK", 0x3AC, 0x23))
#: first and last character of scripts that are written back in their own characters: Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul
BLOCKS = ((0x5D0, 0x5EA), (0x621, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_FEMALE = frozenset(FEMALE)


def _word(bits: int, syllables: int, script: str = "LATIN") -> str:
    return "".join(_SYLLABLES[script][(bits >> 6 * i) & 63] for i in range(syllables))


def _cased(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[:1].isupper() else new


def canonical(kind: str, item: str) -> str:
    """What makes two items the same: letters and digits in lower case; obfuscated mail addresses are spelled out."""
    low = item.lower()
    if kind == "email":
        low = re.sub(r"^mailto:", "", re.sub(_AT, "@", re.sub(r"[ \t]+(?:at|arroba)[ \t]+", "@", low)))
        return re.sub(r"[ \t]?[\[({<]?\b(?:dot|punkt|punto|point)\b[\])}>]?[ \t]?", ".", low)
    return ("+" if kind == "phone" and "+" in item[:2] else "") + re.sub(r"[\W_]+", "", low)


FIELDS = (("pages", "content"), ("session_events", "content"), ("issues", "description"), ("issues", "body"), ("notes", "body"))


def records(pages: DataFrame, events: DataFrame, issues: DataFrame, notes: DataFrame) -> DataFrame:
    """``src, field, record_key, text`` of every non-null text, repeated rows and older states too; each comment is a row."""
    one = lambda df, src, field, key, text: df.select(F.lit(src).alias("src"), F.lit(field).alias("field"), F.col(key).cast("string").alias("record_key"), F.col(text).alias("text"))
    comments = issues.select("id", F.explode("comments.nodes").alias("c")).select("id", F.col("c.body").alias("body"))
    parts = [one(pages, "pages", "content", "path", "content"), one(events, "session_events", "content", "event_id", "content"), one(issues, "issues", "description", "id", "description"), one(comments, "issues", "body", "id", "body"), one(notes, "notes", "body", "note_id", "body")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("text").isNotNull())


REDACTED = "src string, field string, record_key string, text string, kinds array<string>, items array<struct<item:string,surrogate:string>>"


def redact(rows: DataFrame, key: str, mode: str = "surrogate", with_text: bool = True) -> DataFrame:
    """``src, field, record_key, text, kinds, items``: each text with its items replaced, the kinds found, and keyed
    digests of each item and of what stands for it (never the item).

    ``key`` is the secret of the surrogates. Texts are processed whole. Rows with null text are expected to be left out;
    a text without items comes back unchanged with empty arrays. ``with_text=False`` leaves the text null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = Redactor(key, mode)
        for batch in batches:
            texts, kinds, items = [], [], []
            for text in batch["text"]:
                new, found = worker.replaced(text) if text else (text, [])
                texts.append(new if with_text else None)
                kinds.append(sorted({k for k, _, _ in found}))
                items.append([{"item": a, "surrogate": b} for a, b in sorted({(worker.digest(k, i), worker.digest(k, n)) for k, i, n in found})])
            yield pd.DataFrame({"src": batch["src"], "field": batch["field"], "record_key": batch["record_key"], "text": texts, "kinds": kinds, "items": items})

    return rows.select("src", "field", "record_key", "text").mapInPandas(run, REDACTED)


def distinctness(redacted: DataFrame) -> DataFrame:
    """``kind, items, surrogates, merged, split``: over all rows, how many different items and surrogates there are, how
    many surrogates stand for more than one item and how many items have more than one surrogate; both should be 0.

    Pairs combine before the shuffle, so an item that a third of all rows hold is sent once a task. No items, no rows.
    """
    pairs = redacted.select(F.explode("items").alias("p")).select(F.substring_index("p.item", ":", 1).alias("kind"), "p.item", "p.surrogate").distinct()
    by = lambda name: pairs.groupBy("kind", name).agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.count(F.lit(1)).alias(f"{name}s"), F.count_if(F.col("n") > 1).alias(f"{name}_more"))
    both = by("item").join(by("surrogate"), "kind")
    return both.select("kind", "items", "surrogates", F.col("surrogate_more").alias("merged"), F.col("item_more").alias("split"))


def found(redacted: DataFrame) -> DataFrame:
    """``src, field, record_key, kind``, each once."""
    return redacted.where(F.size("kinds") > 0).select("src", "field", "record_key", F.explode("kinds").alias("kind")).distinct()
