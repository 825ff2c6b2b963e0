"""String functions: slugs, links, snippets, scores, formats. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, BLANKS, "")


def slug_words(c: Column) -> Column:
    """Lower case, ends stripped, each blank a hyphen (runs are kept)."""
    return F.replace(strip(F.lower(c)), F.lit(" "), F.lit("-"))


def slug_dashes(c: Column) -> Column:
    """Lower case; each run of other characters than a-z and 0-9 is one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_short(c: Column, size: int = 40, cut_first: bool = True) -> Column:
    """``slug_dashes`` of at most ``size``: cut before the ends are stripped, or after (then a hyphen may end it)."""
    if not cut_first:
        return F.substring(slug_dashes(c), 1, size)
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), 1, size), "^-+|-+$", "")


def slug_file(c: Column, size: int = 80) -> Column:
    """File name of a title: letters, digits, hyphens; ends in ``.md``."""
    kept = strip(F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s-]", ""))
    joined = F.regexp_replace(F.regexp_replace(kept, r"(?U)\s+", "-"), "-+", "-")
    return F.concat(F.regexp_replace(F.substring(joined, 1, size), "-+$", ""), F.lit(".md"))


def slug_underscores(c: Column, size: int = 40) -> Column:
    """Runs of characters that are no letters, digits or underscores (of any script) become an underscore."""
    return F.substring(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", "_"), 1, size)


def wikilinks(c: Column) -> Column:
    """Targets of ``[[target|alias]]`` and ``[[target#anchor]]`` in order."""
    return F.regexp_extract_all(c, F.lit(r"\[\[([^\]|#]+)(?:[|#][^\]]+)?\]\]"), 1)


def raw_wikilinks(c: Column) -> Column:
    """Inner texts of ``[[...]]``, aliases kept, without those that begin with an underscore."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda x: ~x.startswith("_"))


def without_elements(c: Column) -> Column:
    """Without ``<x>...</y>`` spans."""
    return F.regexp_replace(c, r"(?s)<[^>]+>.*?</[^>]+>", "")


def slash_commands(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?:^|\s)/([a-z][a-z0-9-]+)"), 1)


def template_variables(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{(\w+)\}"), 1))


def snippet(text: Column, query: str, before: int = 80, after: int = 160) -> Column:
    """The surroundings of the first literal, case-insensitive hit on one line; empty without one."""
    at = F.locate(query.lower(), F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    piece = F.substring(text, start, at + after - start)
    return F.when(at > 0, strip(F.replace(piece, F.lit("\n"), F.lit(" ")))).otherwise("")


def excerpt(text: Column, size: int = 200) -> Column:
    return F.replace(F.substring(text, 1, size), F.lit("\n"), F.lit(" "))


def holds(text: Column, query: str) -> Column:
    """Literal case-insensitive containment; null text holds nothing."""
    return F.coalesce(F.contains(F.lower(text), F.lit(query.lower())), F.lit(False))


def like(text: Column, query: str) -> Column:
    """As ``holds``, but ``%`` and ``_`` in the query are wildcards."""
    return F.coalesce(F.lower(text).like("%" + query.lower().replace("\\", "\\\\") + "%"), F.lit(False))


def term_score(query: str, title: Column, summary: Column, body: Column, least: int = 3) -> Column:
    """3 for each term in the title, 2 in the summary, 1 in the body; terms shorter than ``least`` don't count."""
    total = F.lit(0)
    for term in (t for t in query.lower().split() if len(t) >= least):
        total = total + holds(title, term).cast("int") * 3 + holds(summary, term).cast("int") * 2 + holds(body, term).cast("int")
    return total


def url_host(c: Column, drop_www: bool = True) -> Column:
    """Network location of a URL with port and user; ``www.`` is removed anywhere."""
    host = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.replace(host, F.lit("www."), F.lit("")) if drop_www else host


def squeeze_lines(c: Column) -> Column:
    """At most one empty line in a row."""
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def project_of_slug(c: Column, skip: tuple[str, ...] = ("home", "workspace", "Workspace", "Downloads")) -> Column:
    """The last part of a hyphenated folder slug that names something; the slug itself if none does."""
    parts = F.filter(F.split(c, "-"), lambda p: (p != "") & ~p.isin(*skip))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), c)


# fixed values: language of a file extension
LANGUAGES = {"py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "md": "Markdown", "json": "JSON", "yaml": "YAML", "yml": "YAML", "sh": "Shell", "bash": "Shell", "ipynb": "Notebook", "sql": "SQL", "toml": "TOML", "html": "HTML", "css": "CSS"}


def language_of(path: Column) -> Column:
    """Language of a path's extension; null if unknown or hidden file without extension."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def canonical_id(c: Column) -> Column:
    """32 hexadecimal digits anywhere in the text (hyphens ignored) as 8-4-4-4-12; the text itself without them."""
    found = F.regexp_extract(F.replace(c, F.lit("-"), F.lit("")), "([0-9a-f]{32})", 1)
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.when(found == "", c).otherwise(F.concat_ws("-", *[F.substring(found, a, n) for a, n in cut]))


def relevance_of(body: Column) -> Column:
    """``Relevance: N/5`` within 1..5, 3 without one."""
    n = F.regexp_extract(body, r"Relevance:\s*(\d)/5", 1).try_cast("int")
    return F.when(n.isNull(), 3).otherwise(F.least(F.greatest(n, F.lit(1)), F.lit(5)))


def inline_tags(body: Column) -> Column:
    """Inline ``#tags`` in lower case, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"#([a-zA-Z][a-zA-Z0-9_-]*)"), 1), F.lower))


def fold_compatible(texts):
    """pandas series in Unicode normal form KC with single blanks (no built-in normalises)."""
    import unicodedata

    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


def redact_simple(c: Column) -> Column:
    """Mail addresses and dotted quads as placeholders (the guard before a model call)."""
    return F.regexp_replace(F.regexp_replace(c, r"[\w.+-]+@[\w-]+\.[\w.-]+", "[EMAIL]"), r"\b\d{1,3}(\.\d{1,3}){3}\b", "[IP]")


def thousands(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def url_quoted(c: Column) -> Column:
    """Percent encoding in which letters, digits, ``_.-~`` and ``/`` stay."""
    out = F.url_encode(c)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def checklist(items: Column) -> Column:
    """A line with an open box for each item; one that says that there is none."""
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- [ ] "), x)), "\n")
    return F.when(F.size(items) > 0, lines).otherwise("- [ ] None detected")


def without_editor_context(c: Column) -> Column:
    """Without the heading that an editor puts before a prompt, and the lines up to the next but one line break."""
    # fixed value: how that heading begins
    return strip(F.regexp_replace(c, r"(?s)\A#\s*Context from my IDE.*?\n.*?\n", ""))


def unfenced(c: Column) -> Column:
    """What stands in a code fence that a text begins with; the text itself without one. Ends are stripped."""
    bare = strip(c)
    inside = F.substring_index(F.regexp_replace(bare, r"\A[^\n]*\n?", ""), "```", 1)
    return F.when(bare.startswith("```"), strip(inside)).otherwise(bare)
