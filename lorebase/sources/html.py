"""HTML to (title, Markdown), by the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: elements that are dropped, rendered, that end a paragraph, that are never closed
DROPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "iframe", "noscript", "svg", "button"}
RENDERED = {"p", "h1", "h2", "h3", "h4", "li", "pre", "blockquote"}
ENDS_P = {"p", "ul", "ol", "pre", "table", "div", "section", "article", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "dl"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.items = tag, dict(attrs), parent, []

    def walk(self):
        for x in self.items:
            if isinstance(x, _Node):
                yield x
                yield from x.walk()

    def text(self) -> str:
        out, stack = [], [iter(self.items)]
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
            elif isinstance(x, str):
                if x.strip():
                    out.append(x.strip())
            else:
                stack.append(iter(x.items))
        return " ".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", (), None)
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skipped += tag not in VOID
        elif not self.skipped:
            if self.at.tag == "p" and tag in ENDS_P or self.at.tag == tag == "li":
                self.at = self.at.parent
            node = _Node(tag, attrs, self.at)
            self.at.items.append(node)
            if tag not in VOID:
                self.at = node

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skipped = max(0, self.skipped - 1)
            return
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if not self.skipped:
            self.at.items.append(data)


def extract(html: str) -> tuple[str, str]:
    """(title, body): the title element or the first h1; blocks of at least 20 characters of the main element."""
    tree = _Tree()
    tree.feed(html or "")
    nodes = list(tree.root.walk())
    first = lambda test: next((n for n in nodes if test(n)), None)
    title = first(lambda n: n.tag == "title" and n.text()) or first(lambda n: n.tag == "h1")
    ids, classes = re.compile("content|main|article|post", re.I), re.compile("content|main|article|post|body", re.I)
    main = first(lambda n: n.tag == "main") or first(lambda n: n.tag == "article") or first(lambda n: ids.search(n.attrs.get("id") or "")) or first(lambda n: classes.search(n.attrs.get("class") or "")) or first(lambda n: n.tag == "body") or tree.root
    parts = []
    for n in main.walk():
        if n.tag in RENDERED and len(text := n.text()) >= 20:
            parts.append({"pre": f"\n```\n{text}\n```\n", "blockquote": f"> {text}"}.get(n.tag, f"\n## {text}\n" if n.tag[0] == "h" else text))
    return (title.text() if title else ""), re.sub(r"\n{3,}", "\n\n", "\n\n".join(parts)).strip()


def extracted(html: pd.Series) -> pd.DataFrame:
    rows = [extract(h) for h in html]
    return pd.DataFrame(rows, columns=["title", "body"])


def captures(pages: DataFrame, day: str) -> DataFrame:
    """``url, url_hash, domain, title, markdown`` of ``url, html`` rows, ready to be written; null html is empty. Where the
    rows have a ``content_type``, only those whose type holds ``html`` are captured."""
    from lorebase.functions.hashing import url_hash
    from lorebase.functions.text import url_host

    def run(batches):
        for b in batches:
            yield pd.concat([b[["url"]].reset_index(drop=True), extracted(b["html"])], axis=1)

    if "content_type" in pages.columns:
        pages = pages.where(F.contains(F.lower("content_type"), F.lit("html")))
    rows = pages.select("url", "html").mapInPandas(run, "url string, title string, body string")
    rows = rows.withColumn("domain", url_host(F.col("url"))).withColumn("url_hash", url_hash(F.col("url")))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), F.col("title")), F.concat(F.lit("url: "), F.col("url")), F.concat(F.lit("url_hash: "), F.col("url_hash")), F.concat(F.lit("domain: "), F.col("domain")), F.lit(f"date: {day}"), F.lit("tags: [web, reference]"), F.lit("---\n"))
    return rows.select("url", "url_hash", "domain", "title", F.concat(head, F.lit("\n# "), F.col("title"), F.lit("\n\n> Source: "), F.col("url"), F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("markdown"))
