"""Link, PDF and image discovery in HTML, natively for plain hrefs and by a parser for everything else."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import IMAGE, PDF, UNFOLLOWED

FOUND = "links array<string>, pdfs array<string>, images array<struct<url:string,alt:string,src_hint:string>>, canonical string, title string, error string"
_PDF, _IMAGE = re.compile(PDF), re.compile(IMAGE)


def hrefs(html: Column) -> Column:
    """array<string>: the href of every a tag, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def title(html: Column) -> Column:
    """The title's text, stripped; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


class _Page(HTMLParser):
    """What one document refers to, in order of appearance: (kind, href, alt). References are resolved at the end, when the base is known."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.references: list[tuple[str, str, str]] = []
        self.canonical: str | None = None
        self.title: str | None = None
        self._in_title, self._pictures = False, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        refer = lambda kind, href, alt="": self.references.append((kind, href, alt))
        candidates = [p.strip().split(" ")[0] for p in a.get("srcset", "").split(",")]
        if tag == "a":
            refer("link", a.get("href", ""))
        elif tag == "img":
            for src in (a.get("src", ""), *candidates):
                refer("img", src, a.get("alt", "").strip())
        elif tag == "picture":
            self._pictures += 1
        elif tag == "source" and self._pictures:
            for src in candidates:
                refer("source", src)
        elif tag == "link" and self.canonical is None and "canonical" in a.get("rel", "").lower().split():
            self.canonical = a.get("href", "").strip() or None
        elif tag == "title":
            self._in_title = self.title is None
        style = a.get("style", "")
        if "background-image" in style and (found := re.search(r"url\(([^)]+)\)", style)):
            refer("style", found[1].strip(" '\""))
        for name in ("data-href", "data-src"):
            refer("data", a.get(name, ""))

    def handle_endtag(self, tag: str) -> None:
        self._in_title = self._in_title and tag != "title"
        self._pictures = max(0, self._pictures - (tag == "picture"))

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title = (self.title or "") + data


def _resolved(base: str, href: str, hosts: tuple[str, ...] | None) -> str | None:
    """href against base; null if it leads nowhere, can't be resolved, or to a host that isn't allowed."""
    href = href.strip()
    if not href or href.startswith(UNFOLLOWED):
        return None
    try:
        url = urljoin(base, href)
        name = urlsplit(url).hostname or ""
    except ValueError:
        return None
    return url if hosts is None or any(name == h or name.endswith(f".{h}") for h in hosts) else None


def parse_page(html: str | None, base: str | None, hosts: tuple[str, ...] | None = None) -> dict:
    """What the page refers to, see discover()."""
    page, error, base, canonical = _Page(), None, base or "", None
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError, RecursionError) as e:  # odd markup, such as <![x[y]]>: what came before it counts
        error = type(e).__name__
    if page.canonical:
        try:
            base = canonical = urljoin(base, page.canonical)
        except ValueError:
            pass
    found = [(kind, url, href, alt) for kind, href, alt in page.references if (url := _resolved(base, href, hosts))]
    links = dict.fromkeys(urldefrag(url)[0] for kind, url, _, _ in found if kind == "link")
    pdfs = dict.fromkeys(url for late in (False, True) for kind, url, _, _ in found if kind == ("data" if late else "link") and _PDF.search(url))
    images: dict[str, dict] = {}
    for wanted in ("img", "source", "style"):
        for kind, url, href, alt in found:
            if kind == wanted and _IMAGE.search(url):
                url = urldefrag(url)[0]
                images.setdefault(url, {"url": url, "alt": alt, "src_hint": href})
    return {"links": [*links], "pdfs": [*pdfs], "images": [*images.values()], "canonical": canonical, "title": (page.title or "").strip() or None, "error": error}


def discover(pages: DataFrame, html: str = "html", base: str = "url", hosts: tuple[str, ...] | None = None) -> DataFrame:
    """pages with `found`: links, pdfs and images (each url once, links and images without fragments), the declared canonical url, the title, and the parser's error.

    References are resolved against the declared canonical url, else the page's own. Markup that the
    parser gives up on costs what follows it on that page, and `error` says so. hosts: hosts that are
    allowed, with their subdomains; all if None. Links to PDFs are in both lists.
    """

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, bases in batches:
            yield pd.DataFrame([parse_page(t, b, hosts) for t, b in zip(texts, bases)], columns=["links", "pdfs", "images", "canonical", "title", "error"])

    return pages.withColumn("found", run(F.col(html), F.col(base)))


def link_edges(discovered: DataFrame, source: str = "url") -> DataFrame:
    """(src, dst, at): a row per link, without links to assets, which are no pages."""
    rows = discovered.select(F.col(source).alias("src"), F.posexplode("found.links").alias("at", "dst"))
    return rows.filter(~F.col("dst").rlike(PDF) & ~F.col("dst").rlike(IMAGE))
