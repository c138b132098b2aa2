"""HTML as text or Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "table", "tr", "ul", "ol", "blockquote", "form", "figure"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def text_of(html: str | None) -> str:
    """Text without scripts and styles, a node a line; empty for null."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return "\n".join(p.parts)


class _Markdown(_Text):
    """Headings, paragraphs, lists, links, emphasis, code and rules; other tags leave their text."""

    _MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`"}

    def __init__(self):
        super().__init__()
        self.lists: list[list] = []
        self.links: list[str] = []
        self.pre = 0

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        if m := re.fullmatch(r"h([1-6])", tag):
            self.parts.append("\n\n" + "#" * int(m[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.parts.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.parts.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "* "))
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.parts.append("[")
        elif tag == "img":
            a = dict(attrs)
            self.parts.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "br":
            self.parts.append("  \n")
        elif tag == "hr":
            self.parts.append("\n\n* * *\n\n")
        elif tag == "pre":
            self.pre += 1
            self.parts.append("\n\n```\n")
        elif tag in _BLOCK:
            self.parts.append("\n\n")
        elif tag in self._MARKS and not self.pre:
            self.parts.append(self._MARKS[tag])

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        if re.fullmatch(r"h[1-6]", tag) or tag in _BLOCK - {"ul", "ol"}:
            self.parts.append("\n\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.parts.append("" if self.lists else "\n\n")
        elif tag == "a" and self.links:
            self.parts.append(f"]({self.links.pop()})")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.parts.append("\n```\n\n")
        elif tag in self._MARKS and not self.pre:
            self.parts.append(self._MARKS[tag])

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data if self.pre else re.sub(r"\s+", " ", data))


def markdown_of(html: str | None) -> str:
    """The page as Markdown; empty for null."""
    p = _Markdown()
    p.feed(html or "")
    p.close()
    lines = re.sub(r"[ \t]+\n", "\n", re.sub(r"(?<! ) \n", "\n", "".join(p.parts)))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x if x.startswith("  ") else x.lstrip(" ") for x in lines.split("\n"))).strip()


FORMS = {"raw": lambda h: h or "", "truncate": text_of, "markdown": markdown_of}


def converted(pages: DataFrame, html: str, mode: str, out: str = "text") -> DataFrame:
    """``pages`` with ``out``: the page as it is (raw), its text (truncate) or Markdown, in place of ``html``."""
    if mode not in FORMS:
        raise ValueError(f"no mode {mode}")
    form, at = FORMS[mode], pages.columns.index(html)
    rest = [c for c in pages.columns if c not in (html, out)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[rest].assign(**{out: [form(h) for h in pdf.iloc[:, at]]})

    return pages.mapInPandas(run, T.StructType([*(pages.schema[c] for c in rest), T.StructField(out, T.StringType())]))
