"""The stages from a crawl to answers as jobs: each reads the tables that the options name, adds to its own, and returns counts.

What fails or is left out is written beside the results, in a table with the suffix `.log`: stage, url, reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..config import Options
from ..functions import url as U
from ..operators import chunk, crawl, documents, index, links, normalize, retrieve
from ..sources import extract, fetch, pictures, records, sitemap
from ..storage import cut, exists

LOG = "stage string, url string, reason string"


def _log(rows: DataFrame, stage: str, url: Column, reason: Column, path: str) -> int:
    out = cut(rows.select(F.lit(stage).alias("stage"), url.alias("url"), reason.cast("string").alias("reason")), "log")
    if n := out.count():
        out.write.mode("append").parquet(f"{path}.log")
    return n


def _there(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def collect(spark: SparkSession, options: Options, get: fetch.Fetcher | Callable[[], fetch.Fetcher], get_bytes: Callable[[], fetch.BinaryFetcher], at: Column, attempts: int | None = None) -> dict[str, int]:
    """Seeds from robots.txt, sitemaps and options.start_urls; the crawl; its assets. Adds the raw files and the manifest to options.bronze.

    get, get_bytes: make a fetcher, once per task; they apply options.timeout_s themselves, as connections are theirs.
    at: the time of the run. Assets that earlier runs have are not fetched again.
    """
    fetcher = fetch.fetch_all(get, options.requests_per_second)
    text = lambda urls: fetcher(urls).filter("status = 200")
    origins = spark.createDataFrame([(o,) for o in crawl.origins(options)], "origin string")
    robots = text(origins.select(F.concat("origin", F.lit("/robots.txt")).alias("url"))).select(F.regexp_replace("url", "/robots.txt$", "").alias("origin"), "body")
    maps = sitemap.discover_sitemaps(origins.join(robots, "origin", "left"))
    pages = sitemap.expand(maps.select("url"), text, options.allowed_hosts, options.sitemap_cap)
    given = spark.createDataFrame([(u, i) for i, u in enumerate(options.start_urls)], "url string, ordinal long")
    starts = crawl.seeds(pages.select("url", F.xxhash64("url").alias("ordinal")), given, options)

    out = crawl.crawl(starts.select("url"), fetcher, lambda p: links.discover(p, hosts=options.allowed_hosts), options)
    seen = _there(spark, f"{options.bronze}/manifest", S.MANIFEST).filter("record = 'asset'").select("url").distinct()
    got, failed = fetch.download(out["mentions"], get_bytes, options.requests_per_second, seen, attempts)
    crawl.write_raw(crawl.raw_files(out["pages"], got), f"{options.bronze}/raw")
    rows = crawl.manifest(out["pages"], got, at)
    rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.MANIFEST])
    rows.write.mode("append").parquet(f"{options.bronze}/manifest")
    why = F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("none")))
    skipped = _log(out["failed"], "page", F.col("url"), why, f"{options.bronze}/manifest") + _log(failed, "asset", F.col("url"), why, f"{options.bronze}/manifest")
    odd = _log(out["pages"].filter("found.error IS NOT NULL"), "links", F.col("url"), F.col("found.error"), f"{options.bronze}/manifest")
    return {"pages": out["pages"].count(), "assets": got.count(), "failed": skipped, "odd": odd}


def build_documents(
    spark: SparkSession, options: Options, at: Column, html: Callable[[Column], Column] = extract.extract_html, pdf: Callable[[Column], Column] | None = None,
    reader: Callable[[], pictures.Reader] | None = None, decoder: Callable[[], pictures.Decoder] = pictures.PillowDecoder, scope: str = "global",
) -> dict[str, int]:
    """Documents of all raw pages, and of PDFs and pictures where their engines are given, whose contents options.documents lacks."""
    manifest = _there(spark, f"{options.bronze}/manifest", S.MANIFEST)

    def files(rows: DataFrame, kind: str) -> DataFrame:
        once = rows.dropDuplicates(["path"])
        return cut(once.join(crawl.read_raw(spark, f"{options.bronze}/raw", kind).select("path", "content"), "path"), kind)

    pages = files(records.manifest_pages(manifest), "html").withColumn("html", F.col("content").cast("string"))
    parts = [documents.html_documents(pages, at, extract=html)]
    logged = 0
    if pdf is not None:
        found = cut(files(records.manifest_assets(manifest, "pdf"), "pdf").withColumn("e", pdf(F.col("content"))).select("url", "page", "e.*"), "pdfs")
        logged += _log(found.filter("markdown IS NULL AND plain IS NULL AND pages IS NULL"), "pdf", F.col("url"), F.lit("not read"), options.documents)
        parts.append(documents.pdf_documents(found, at))
    if reader is not None:
        images = files(records.manifest_assets(manifest, "image"), "image")
        low = cut(images.withColumn("low", pictures.reading(pictures.gate_scale, reader, decoder)(F.col("content"))).select("url", "page", "alt", "src_hint", "content", "low.*"), "pictures")
        logged += _log(low.filter("img_h IS NULL"), "image", F.col("url"), F.lit("not read"), options.documents)
        high = pictures.reading(pictures.text_scale, reader, decoder)
        chosen = low.filter(documents.gate()).withColumn("read", high(F.col("content"))["boxes"]).drop("content")
        parts.append(documents.image_documents(cut(chosen, "pictures"), at))
    fresh = documents.corpus([_as(p, S.DOCUMENT) for p in parts], documents.known(_there(spark, options.documents, S.DOCUMENT)), scope)
    fresh = cut(fresh, "documents")
    fresh.write.mode("append").parquet(options.documents)
    return {"added": fresh.count(), "failed": logged}


def build_chunks(spark: SparkSession, options: Options, split: Callable[[Column, Column, Column], Column] = chunk.chunks, count: Callable[[Column], Column] | None = None) -> dict[str, int]:
    """Chunks of all documents, in place of those in options.chunks."""
    out = cut(chunk.chunk_documents(_there(spark, options.documents, S.DOCUMENT), split, count, options), "chunks")
    out.write.mode("overwrite").parquet(options.chunks)
    return {"chunks": out.count()}


def build_vectors(spark: SparkSession, options: Options, make: Callable[[], index.Embedder] = index.HashEmbedder, count: Callable[[Column], Column] | None = None) -> dict[str, int]:
    """Embeds what of the chunks is embeddable and not in options.vectors yet, and appends it."""
    rows = cut(normalize.judged(_there(spark, options.chunks, S.CHUNK), options, "id", count), "judged")
    counted = rows.transform(normalize.counters).first().asDict()
    loaded = index.load(spark, options.vectors, normalize.embeddable(rows), make)
    return counted | {"added": loaded["added"], "vectors": loaded["total"]}


def ask(spark: SparkSession, options: Options, questions: DataFrame, embed: Callable[[Column], Column] = index.embed, make: Callable[[], retrieve.Generator] | None = None, **more) -> DataFrame:
    """Answers to questions (query_id long, query) from options.vectors: see retrieve.answer()."""
    hits = cut(retrieve.search(index.read_vectors(spark, options.vectors), questions, embed, options, **more), "hits")
    return retrieve.answer(questions, hits, make)


def _as(rows: DataFrame, schema) -> DataFrame:
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
