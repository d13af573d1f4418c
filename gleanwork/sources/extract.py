"""Extractors for HTML, PDF and pictures: protocols, with an offline default for HTML."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACTED = "text string, title string, published_at string, updated_at string"


class HtmlExtractor(Protocol):
    def __call__(self, html: str) -> dict[str, str | None]:
        """text, and title, published_at, updated_at if known."""


class PdfExtractor(Protocol):
    def __call__(self, content: bytes) -> dict:
        """markdown, plain and pages (each with own, plain and ocr text), any of them empty."""


class OcrEngine(Protocol):
    def __call__(self, content: bytes) -> dict:
        """img_h, img_w, boxes."""


PDF = "markdown string, plain string, pages array<struct<own:string,plain:string,ocr:string>>"
OCR = "img_h int, img_w int, boxes array<struct<poly:array<struct<x:double,y:double>>,text:string,conf:double>>"


def _by_row(kind: str, fields: tuple[str, ...], make: Callable[[], Callable[[bytes], dict]]) -> Callable[[Column], Column]:
    """A Column function of file contents. The engine is made once per stream of batches; files that it fails on have null fields."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        engine = make()
        for batch in batches:
            rows = []
            for content in batch:
                try:
                    rows.append(engine(bytes(content)) if content is not None else {})
                except Exception:  # noqa: BLE001  a file that can't be read is a file without contents
                    rows.append({})
            yield pd.DataFrame([[r.get(k) for k in fields] for r in rows], columns=fields, dtype="object")

    return run


def extract_pdf(make: Callable[[], PdfExtractor]) -> Callable[[Column], Column]:
    """content -> struct of PDF, for pdf_documents()."""
    return _by_row(PDF, ("markdown", "plain", "pages"), make)


def read_picture(make: Callable[[], OcrEngine]) -> Callable[[Column], Column]:
    """content -> struct of OCR, for image_documents()."""
    return _by_row(OCR, ("img_h", "img_w", "boxes"), make)


#: Elements without text of the page, and those that end a line.
SKIPPED = frozenset(("script", "style", "noscript", "template", "svg", "nav", "head"))
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main ol p pre section table td th tr ul".split())
META_PUBLISHED = frozenset(("article:published_time", "date", "dc.date", "datepublished"))
META_UPDATED = frozenset(("article:modified_time", "last-modified", "og:updated_time", "datemodified"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list[str]] = [[]]
        self.skipped: list[str] = []
        self.meta: dict[str, str | None] = {"title": None, "published_at": None, "updated_at": None}
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "title":
            self.in_title = self.meta["title"] is None
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            for key, names in (("published_at", META_PUBLISHED), ("updated_at", META_UPDATED)):
                if name in names and a.get("content"):
                    self.meta[key] = self.meta[key] or a["content"]
        if tag in SKIPPED:
            self.skipped.append(tag)
        if tag in BLOCKS:
            self.lines.append([])

    def handle_endtag(self, tag: str) -> None:
        self.in_title = self.in_title and tag != "title"
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass
        if tag in BLOCKS:
            self.lines.append([])

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.meta["title"] = ((self.meta["title"] or "") + data).strip() or None
        elif not self.skipped:
            self.lines[-1].append(data)


def plain_html(html: str) -> dict[str, str | None]:
    """The text outside scripts, styles and navigation, a line per block; up to markup that the parser gives up on, such as <![x[y]]>."""
    page = _Text()
    try:
        page.feed(html)
        page.close()
    except AssertionError:
        pass
    lines = (" ".join("".join(x).split()) for x in page.lines)
    return {"text": "\n".join(x for x in lines if x)} | page.meta


def extract_html(html: Column, make: Callable[[], HtmlExtractor] = lambda: plain_html) -> Column:
    """struct of EXTRACTED; a page that the extractor fails on has a null text."""

    @F.pandas_udf(EXTRACTED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        extract = make()
        for batch in batches:
            rows = []
            for html in batch:
                try:
                    rows.append(extract(html) if html else {})
                except Exception:  # noqa: BLE001  a page that can't be parsed is a page without text
                    rows.append({})
            yield pd.DataFrame([{k: r.get(k) for k in ("text", "title", "published_at", "updated_at")} for r in rows], columns=["text", "title", "published_at", "updated_at"], dtype="object")

    return run(html)
