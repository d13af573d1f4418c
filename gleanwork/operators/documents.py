"""Documents from pages, pictures and PDFs: gates, fallbacks and record assembly.

Extraction is injected; what decides over its results is built in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ocr as O
from ..functions import text as T
from ..functions import url as U
from ..sources.extract import extract_html
from .dedup import dedup_incremental, known_hashes


def html_documents(pages: DataFrame, captured_at: Column, url: str = "url", html: str = "html", extract: Callable[[Column], Column] = extract_html) -> DataFrame:
    """Pages with a text, as DOCUMENT rows without dedup: the id is the hash of the url."""
    rows = pages.select(F.col(url).alias("source_url"), extract(F.col(html)).alias("e"))
    rows = rows.withColumn("text_full", T.strip(F.col("e.text"))).filter("text_full <> ''")
    return rows.select(
        F.sha1("source_url").alias("id"), "source_url", F.lit("html").alias("source_type"), "text_full", F.sha1("text_full").alias("content_hash"),
        captured_at.alias("captured_at"), "e.title", "e.published_at", "e.updated_at",
    )


def gate(**options) -> Column:
    """Whether a picture (img_h, img_w, boxes, alt, src_hint) is an infographic."""
    return O.is_infographic(F.col("img_h"), F.col("img_w"), F.col("boxes"), F.col("alt"), F.col("src_hint"), **options)


def image_documents(images: DataFrame, captured_at: Column, **options) -> DataFrame:
    """Infographics as DOCUMENT rows without dedup. images: url, page, alt, src_hint; img_h, img_w; boxes as read for the gate; and as read for the text, `read`, in the same coordinates."""
    text = T.strip(O.joined_text(F.col("read")))
    rows = images.filter(gate(**options)).withColumn("text_full", text).filter("text_full <> ''")
    hash_ = F.sha1("text_full")
    ratio = O.area_ratio(F.col("read"), F.col("img_h"), F.col("img_w"))
    return rows.select(
        hash_.alias("id"), F.col("url").alias("source_url"), F.lit("image").alias("source_type"), F.lit(True).alias("is_infographic"), "text_full", "alt", hash_.alias("content_hash"),
        captured_at.alias("captured_at"), "page", F.bround(O.mean_confidence(F.col("read")), 3).alias("ocr_avg_conf"), F.bround(ratio, 4).alias("ocr_text_area_ratio"),
    )


def page_text(own: Column, plain: Column, ocr: Column, detect=T.th_en) -> Column:
    """One PDF page: the first of the two text layers that passes the gate, else what OCR read; stripped."""
    good = lambda t: T.qc_ok(t, 30) & T.usable_th_en(t, 30, 0.55, detect)
    own, plain = T.strip(F.coalesce(own, F.lit(""))), T.strip(F.coalesce(plain, F.lit("")))
    return F.when(good(own), own).when(good(plain), plain).otherwise(T.strip(F.coalesce(ocr, F.lit(""))))


def accepted(text: Column, min_chars: int = 150, detect=T.th_en) -> Column:
    """Whether a whole file's text passes: readable, and Thai or English or long."""
    return T.qc_ok(text, min_chars) & (T.usable_th_en(text, min_chars, 0.65, detect) | (F.length(text) >= 2 * min_chars))


def _chosen(markdown: Column, plain: Column, min_chars: int, detect, *then: Column) -> Column:
    """The first of `then` if the Markdown is accepted, the second if the plain text is, else the third; both stripped and not null."""
    return F.when(accepted(markdown, min_chars, detect), then[0]).when(accepted(plain, min_chars, detect), then[1]).otherwise(then[2])


def pdf_step(markdown: Column, plain: Column, min_chars: int = 150, detect=T.th_en) -> Column:
    """Where pdf_cascade() takes the text from: markdown, plain or pages."""
    markdown, plain = T.strip(F.coalesce(markdown, F.lit(""))), T.strip(F.coalesce(plain, F.lit("")))
    return _chosen(markdown, plain, min_chars, detect, F.lit("markdown"), F.lit("plain"), F.lit("pages"))


def pdf_cascade(markdown: Column, plain: Column, pages: Column, min_chars: int = 150, detect=T.th_en, separator: str = "") -> Column:
    """The text of a PDF: its Markdown or its plain text if accepted, else its pages' texts; null if all is empty.

    pages: array<string>, as page_text() gives them; empty ones are left out.
    """
    markdown, plain = T.strip(F.coalesce(markdown, F.lit(""))), T.strip(F.coalesce(plain, F.lit("")))
    rest = T.strip(F.array_join(F.filter(pages, lambda p: p != ""), separator))
    return _chosen(markdown, plain, min_chars, detect, markdown, plain, F.nullif(rest, F.lit("")))


def pdf_documents(pdfs: DataFrame, captured_at: Column, detect=T.th_en, separator: str = "") -> DataFrame:
    """PDFs as DOCUMENT rows without dedup. pdfs: url, page, markdown, plain, pages (array<struct<own, plain, ocr>>)."""
    texts = F.transform(F.coalesce("pages", F.array()), lambda p: page_text(p["own"], p["plain"], p["ocr"], detect))
    rows = pdfs.withColumn("text_full", pdf_cascade(F.col("markdown"), F.col("plain"), texts, detect=detect, separator=separator)).filter("text_full IS NOT NULL")
    hash_ = F.sha1("text_full")
    return rows.select(
        hash_.alias("id"), F.col("url").alias("source_url"), F.lit("pdf_md").alias("source_type"), F.lit("markdown").alias("format"), T.md_has_table(F.col("text_full")).alias("has_tables"),
        "text_full", hash_.alias("content_hash"), captured_at.alias("captured_at"), "page",
    )


def corpus(parts: list[DataFrame], seen: DataFrame | None = None, scope: str = "global") -> DataFrame:
    """All documents, each content once: by default over all sources and earlier runs; scope per_type: within each source type."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    order = ["source_type", "source_url", "id"]
    return dedup_incremental(out, seen, "content_hash", order, "source_type" if scope == "per_type" else None)


def known(earlier: DataFrame) -> DataFrame:
    """content_hash of earlier documents, for corpus()."""
    return known_hashes(earlier)


def domain(url: Column) -> Column:
    return F.coalesce(U.host(url), F.lit(""))
