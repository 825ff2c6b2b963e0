"""Front matter in its four dialects.

``index``: delimiter is the first ``---`` after the third character, only ``tags`` is a list. ``note``: delimiter is a
``---`` at the start of a line, inline lists, booleans, integers and nulls are typed as text. ``command``: only the
``description``. ``yaml``: real YAML, parsed by a library where there is one, else by the subset ``note`` reads.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.functions.text import strip


def _pairs(block: Column) -> Column:
    """key -> value of ``key: value`` lines; of equal keys the last counts."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    keys = F.transform(lines, lambda x: F.substring_index(x, ":", 1))
    first = F.array_distinct(keys)
    value = lambda k: F.element_at(F.filter(lines, lambda x: x.startswith(F.concat(k, F.lit(":")))), -1)
    return F.map_from_arrays(first, F.transform(first, lambda k: strip(F.substring(value(k), F.length(k) + 2, F.length(value(k))))))


def index_block(text: Column) -> Column:
    """The text between ``---`` at the start and the next ``---`` anywhere; empty without both."""
    rest = F.substring(text, 4, F.length(text))
    return F.when(text.startswith("---") & (F.locate("---", rest) > 0), F.substring_index(rest, "---", 1)).otherwise("")


def index_fields(text: Column) -> Column:
    """Map of the index dialect; quotes around values are removed."""
    return F.transform_values(_pairs(index_block(text)), lambda k, v: F.regexp_replace(v, r"^[\"']|[\"']$", ""))


def index_tags(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(index_fields(text)["tags"], F.lit("")), F.lit(r"(?U)([\w-]+)"), 1)


def note_block(text: Column) -> Column:
    rest = F.substring(text, 4, F.length(text))
    return F.when(text.startswith("---") & (F.locate("\n---", rest) > 0), F.substring_index(rest, "\n---", 1)).otherwise("")


def note_fields(text: Column) -> Column:
    """Map of the note dialect; ``~`` and empty values are null, quotes removed."""
    return F.transform_values(_pairs(note_block(text)), lambda k, v: F.when((v == "~") | (v == ""), F.lit(None)).otherwise(F.regexp_replace(v, r"^[\"']|[\"']$", "")))


def note_list(value: Column) -> Column:
    """Items of an inline list ``[a, b]``; a scalar is one item, null none."""
    inner = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    items = F.filter(F.transform(F.split(F.when(value.startswith("["), inner).otherwise(value), ","), strip), lambda x: x != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def note_flag(value: Column) -> Column:
    return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)


def note_number(value: Column) -> Column:
    return F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("bigint"))


def body_after(text: Column) -> Column:
    """The text behind the front matter."""
    return F.when(note_block(text) != "", strip(F.regexp_replace(F.substring(text, 4 + F.length(note_block(text)) + 1, F.length(text)), r"^---[^\n]*\n?", ""))).otherwise(text)


def command_description(text: Column) -> Column:
    """The first ``description:`` of a front matter that isn't empty."""
    return F.when(index_block(text) != "", strip(F.regexp_extract(index_block(text), r"(?m)^description:[ \t]*(.*)$", 1))).otherwise("")


def yaml_fields(texts: pd.Series) -> pd.Series:
    """Series of dicts (JSON-ready) of real YAML front matter; a malformed one is null. For use in pandas functions."""
    try:
        import yaml
    except ImportError:
        yaml = None

    def one(text):
        if not text or not text.startswith("---"):
            return {}
        parts = text.split("\n---", 1)
        if len(parts) < 2:
            return {}
        if yaml is None:
            return {k: v.strip() for k, _, v in (line.partition(":") for line in parts[0].splitlines()[1:]) if k and v and not k.startswith((" ", "-"))}
        try:
            found = yaml.safe_load(parts[0][3:]) or {}
            return {str(k): None if v is None else str(v) for k, v in found.items()} if isinstance(found, dict) else None
        except yaml.YAMLError:
            return None

    return texts.map(one)
