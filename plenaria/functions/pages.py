"""Transcript pages: agenda entries, sections, main text, tables of contents and text between anchors.

One pass of the standard library's HTML parser over a page gives its events; each
function below is a reading of them, and runs on Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.settings import bounded_batches

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template"}
MAIN = {("class", "doc-content"), ("class", "ep_text"), ("class", "content"), ("id", "content"), ("class", "main-content")}
ARROW = "arrow_title_doc.gif"
ORDINAL = re.compile(r"^(\d+(?:\.\d+)*)\s*\.")
DOCUMENT = re.compile(r"/doceo/document/([^/_]+(?:-[^/_]+)*)_EN\.html", re.I)


# Fixed values of HTML: what a start tag ends although its end tag is missing, up to the nearest of the second set.
BLOCKS = (
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul"
).split()
CELL, ROW = {"td", "th"}, {"tr", "td", "th"}
IMPLIED = {b: ({"p"}, {"table", "td", "th", "caption", "button", "object"}) for b in BLOCKS} | {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": (CELL, {"tr", "table"}), "th": (CELL, {"tr", "table"}), "tr": (ROW, {"table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (ROW | {"tbody", "thead", "tfoot"}, {"table"})),
}


@dataclass
class Element:
    tag: str
    attrs: dict
    start: int  # offset in the page's text
    place: int  # offset in the page's source
    after: int  # number of the first element inside
    end: int = -1
    until: int = -1  # number of the first element behind it


class Page(HTMLParser):
    """Elements in order, and the visible text with each one's offsets in it. Missing end tags are implied as HTML has it."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.text, self._open, self._tags, self._hidden, self._n = [], [], Counter(), 0, 0
        self.source = html or ""
        self._lines = [0]
        for line in self.source.split("\n"):
            self._lines.append(self._lines[-1] + len(line) + 1)
        self.feed(self.source)
        self.close()
        self.body = "".join(self.text)
        self._close(0)

    def _close(self, keep: int) -> None:
        """End all open elements but the outermost `keep`."""
        while len(self._open) > keep:
            e = self._open.pop()
            e.end, e.until = self._n, len(self.elements)
            self._tags[e.tag] -= 1
            self._hidden -= e.tag in HIDDEN

    def handle_starttag(self, tag, attrs):
        ended, bounds = IMPLIED.get(tag, ((), ()))
        if any(self._tags[t] for t in ended):
            keep = len(self._open)
            for i in range(len(self._open) - 1, -1, -1):
                if self._open[i].tag in ended:
                    keep = i
                elif self._open[i].tag in bounds:
                    break
            self._close(keep)
        line, column = self.getpos()
        element = Element(tag, {k: v or "" for k, v in attrs}, self._n, self._lines[line - 1] + column, len(self.elements) + 1)
        self.elements.append(element)
        if tag in VOID:
            element.end, element.until = self._n, len(self.elements)
        else:
            self._open.append(element)
            self._tags[tag] += 1
            self._hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self._tags[tag]:
            self._close(next(i for i in range(len(self._open) - 1, -1, -1) if self._open[i].tag == tag))

    def inside(self, e: Element) -> list[Element]:
        return self.elements[e.after : e.until]

    def handle_data(self, data):
        if not self._hidden:
            self.text.append(data)
            self._n += len(data)

    def of(self, e: Element) -> str:
        return self.body[e.start : e.end]

    def first(self, wanted) -> Element | None:
        return next((e for e in self.elements if wanted(e)), None)


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def headers(page: Page) -> list[tuple[Element, dict]]:
    out = []
    for e in page.elements:
        if e.tag == "td" and "doc_title" in e.attrs.get("class", "").split() and any(i.tag == "img" and ARROW in i.attrs.get("src", "") for i in page.inside(e)):
            raw = squeezed(page.of(e))
            ordinal = ORDINAL.match(raw)
            title = re.sub(r"\s*\([^)]*\)\s*$", "", ORDINAL.sub("", raw).strip()).strip()
            links = (DOCUMENT.search(i.attrs.get("href", "")) for i in page.inside(e) if i.tag == "a")
            out.append((e, {"ordinal": ordinal[1] if ordinal else None, "title": title, "docIdentifier": next((m[1] for m in links if m), None), "raw": raw}))
    return out


def agenda(html: str | None) -> list[dict]:
    """Agenda entries (ordinal, title, docIdentifier, raw), repetitions left out."""
    seen, out = set(), []
    for _, h in headers(Page(html)):
        key = h["docIdentifier"], h["title"].lower()
        if h["title"] and key not in seen:
            seen.add(key)
            out.append(h)
    return out


def sections(html: str | None) -> list[dict]:
    """(title, docIdentifier, text) from each header to the next one."""
    page = Page(html)
    found = headers(page)
    ends = [e.start for e, _ in found[1:]] + [len(page.body)]
    return [{"title": h["title"], "docIdentifier": h["docIdentifier"], "text": squeezed(page.body[e.start : end])} for (e, h), end in zip(found, ends)]


def main_text(html: str | None) -> str:
    """The main part's text if it has over 100 characters, else the body's, else the paragraphs."""
    page = Page(html)
    main = page.first(lambda e: any((k, v) in MAIN for k in ("class", "id") for v in e.attrs.get(k, "").split()))
    if main and len(text := page.of(main).strip()) > 100:
        return text
    body = page.first(lambda e: e.tag == "body")
    text = (page.of(body) if body else page.body).strip()
    return text if len(text) > 100 else "\n".join(page.of(e) for e in page.elements if e.tag == "p").strip()


def contents(html: str | None) -> list[dict]:
    """(anchor, title) of the links to places in the page."""
    page = Page(html)
    links = [(e.attrs.get("href", "")[1:], squeezed(page.of(e))) for e in page.elements if e.tag == "a" and e.attrs.get("href", "").startswith("#")]
    return [{"anchor": a, "title": t} for a, t in links if a and t]


def between_anchors(html: str | None, anchor: str) -> str:
    """Text from an anchor (by name or id, else by a part of it) to the next anchor; else the paragraphs, else the body."""
    page = Page(html)
    named = [(e, e.attrs.get("name") or e.attrs.get("id") or "") for e in page.elements if e.tag == "a" or "id" in e.attrs]
    named = [(e, n) for e, n in named if n]
    at = next((i for i, (_, n) in enumerate(named) if n == anchor), None)
    if at is None and anchor:
        at = next((i for i, (_, n) in enumerate(named) if anchor in n), None)
    if at is not None:
        end = next((e.start for e, _ in named[at + 1 :] if e.start > named[at][0].start), len(page.body))
        if text := squeezed(page.body[named[at][0].start : end]):
            return text
    return squeezed("\n".join(page.of(e) for e in page.elements if e.tag == "p")) or squeezed(page.body)


def paragraphs(html: str | None) -> list[str]:
    page = Page(html)
    return [t for e in page.elements if e.tag == "p" and (t := squeezed(page.of(e)))]


KINDS = {
    agenda: "array<struct<ordinal:string,title:string,docIdentifier:string,raw:string>>",
    sections: "array<struct<title:string,docIdentifier:string,text:string>>",
    main_text: "string",
    contents: "array<struct<anchor:string,title:string>>",
    paragraphs: "array<string>",
}


def read(pages: DataFrame, reading, html: str = "html", name: str = "value") -> DataFrame:
    """`pages` with the column `name`: a reading of each page."""

    @F.pandas_udf(KINDS[reading])
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(reading)

    bounded_batches(pages.sparkSession)
    return pages.withColumn(name, run(html))


def read_anchor(pages: DataFrame, anchor: str, html: str = "html", name: str = "value") -> DataFrame:
    """`pages` with the text at the anchor that each row names."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, anchors: pd.Series) -> pd.Series:
        return pd.Series([between_anchors(t, a or "") for t, a in zip(texts, anchors)])

    bounded_batches(pages.sparkSession)
    return pages.withColumn(name, run(html, anchor))
