"""Main text of fetched web pages."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clauseflow import vocab as V
from clauseflow.functions.text import strip

# ---------------------------------------------------------------- fixed values
_SILENT = {"script", "style", "template", "noscript", "head", "title"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li",
    "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul", "br",
}
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
    "track", "wbr",
}
# These references also count without their semicolon.
OPEN_ENTITIES = "&(lt|gt|quot|nbsp|copy|reg|middot|amp);?"
# Common character references; the ampersand comes last, so that none is read twice.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"),
)
# ------------------------------------------------------------ end fixed values


def _matches(selector: str, tag: str, attrs: dict[str, str | None], above: list[str]) -> bool:
    if selector.startswith("#"):
        return attrs.get("id") == selector[1:]
    if selector.startswith("."):
        return selector[1:] in (attrs.get("class") or "").split()
    if selector.startswith("["):
        name, _, value = selector[1:-1].partition("=")
        return attrs.get(name) == value.strip("'\"")
    *outer, last = selector.split()
    return tag == last and all(o in above for o in outer)


class _Containers(HTMLParser):
    """Collects the text of the first element that matches each selector."""

    def __init__(self, selectors: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.open: list[str] = []
        self.pieces: list[str] = []
        self.begun: dict[str, tuple[int, int]] = {}
        self.spans: dict[str, tuple[int, int]] = {}
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        table = dict(attrs)
        if tag in _BLOCK:
            self.pieces.append("\n")
        for selector in self.selectors:
            if selector not in self.begun and _matches(selector, tag, table, self.open):
                self.begun[selector] = (len(self.open), len(self.pieces))
        if tag in _VOID:
            return
        self.open.append(tag)
        self.silent += tag in _SILENT

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            top = self.open.pop()
            self.silent -= top in _SILENT
            if top in _BLOCK:
                self.pieces.append("\n")
            self._close(len(self.open))
            if top == tag:
                break

    def handle_data(self, data):
        if not self.silent:
            self.pieces.append(re.sub(r"\s+", " ", data))

    def _close(self, depth):
        for selector, (at, first) in self.begun.items():
            if at >= depth and selector not in self.spans:
                self.spans[selector] = (first, len(self.pieces))

    def texts(self):
        self._close(-1)
        for selector in self.selectors:
            if selector in self.spans:
                first, last = self.spans[selector]
                text = "".join(self.pieces[first:last])
                yield re.sub(r" *\n[ \n]*", "\n", re.sub(r" {2,}", " ", text)).strip()


def _main_text(page: str, selectors: Sequence[str], min_chars: int) -> str:
    parser = _Containers(selectors)
    parser.feed(page)
    parser.close()
    return next((t for t in parser.texts() if len(t) >= min_chars), "")


def main_text(
    html: Column,
    selectors: Sequence[str] = V.MAIN_CONTAINERS,
    min_chars: int = V.MIN_BODY_CHARS,
) -> Column:
    """Text of the first container, in order, that has enough of it; else empty.

    HTML nests, which regular expressions cannot follow, so this one runs in Python,
    a batch of pages at a time.
    """

    @F.pandas_udf(StringType())
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: _main_text(page, selectors, min_chars), na_action="ignore")

    return extract(html)


def element_text(html: Column, tag: str) -> Column:
    """Text of the first ``tag`` element with regular expressions only, in the JVM.

    Right where that element holds no other of its kind.
    """
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}>|\z)", 1)
    text = F.regexp_replace(inner, r"(?is)<(script|style)\b.*?</(?:script|style)>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|/?(?:p|div|li|ul|h[1-6]|article|nav|footer))\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    text = F.regexp_replace(text, OPEN_ENTITIES, "&$1;")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r" ?\n[ \n]*", "\n"))


def builtin_main_text(
    html: Column, tags: Sequence[str] = ("article", "main", "body"), min_chars: int = V.MIN_BODY_CHARS
) -> Column:
    """The same choice over plain tags, without leaving the JVM."""
    texts = [element_text(html, t) for t in tags]
    return F.coalesce(*[F.when(F.length(t) >= min_chars, t) for t in texts], F.lit(""))
