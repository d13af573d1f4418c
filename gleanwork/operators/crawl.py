"""Breadth-first walks over a link table, and the stages of a crawl around them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Options
from ..functions import url as U
from ..storage import cut
from .dedup import keep_first, not_seen


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int | None = None) -> DataFrame:
    """(node, depth) for what can be reached from seeds (node) over edges (src, dst), with its smallest depth.

    One job per level: the frontier meets the edges, and what is known already is left out by an anti
    join, so cycles end. Every level is written to the shared folder, which keeps plans short.
    max_nodes cuts off after so many nodes, by depth and then name.
    """
    frontier = cut(seeds.select("node").filter("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "level")
    levels = frontier
    edges = cut(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    for depth in range(1, max_depth + 1):
        reached = frontier.select("node").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(not_seen(reached, levels, "node").withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        levels = levels.union(frontier)
    return levels.orderBy("depth", "node").limit(max_nodes) if max_nodes is not None else levels


def seeds(sitemap_urls: DataFrame, start_urls: DataFrame, options: Options = Options()) -> DataFrame:
    """(url, ordinal): sitemaps' urls first, then start urls, canonical and allowed, each once. Both inputs: url, ordinal."""
    both = sitemap_urls.select("url", "ordinal", F.lit(0).alias("group")).union(start_urls.select("url", "ordinal", F.lit(1)))
    both = both.withColumn("url", U.canonical_url(F.col("url"))).filter(U.host_allowed(F.col("url"), options.allowed_hosts))
    return keep_first(both, "url", ["group", "ordinal"])


def origins(options: Options) -> list[str]:
    return sorted({f"https://{h}" for h in options.allowed_hosts})


Fetch = Callable[[DataFrame], DataFrame]  # (url) -> (url, status, content_type, body)


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """df with each row's place in the order, from 0: sorted over all tasks, so that no task sees all rows. A written table."""
    rows = cut(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One number per task.
    before, starts = 0, []
    for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["rows"]
    at = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return rows.withColumn("_part", part).join(F.broadcast(at), "_part").withColumn(name, F.col("_start") + within).drop("_part", "_start", "_at")


def crawl(starts: DataFrame, fetch: Fetch, discover: Callable[[DataFrame], DataFrame], options: Options = Options()) -> dict[str, DataFrame]:
    """Pages, assets and failures of a crawl from starts (url), fetched level by level.

    Pages are marked before they are fetched, so failures aren't tried again; a page at the last depth
    is fetched, but its links are not followed. With options.max_pages, a level is fetched in rounds in
    order of urls, each of as many as are still missing, until so many pages have answered. Returns
    `pages` (url, canonical, depth, html, found); `mentions` of assets (url, kind, page, alt, src_hint,
    depth, at), which download() takes; `assets`, the first mention of each; and `failed` (url, status,
    content_type, depth).
    """
    known = cut(starts.select(U.canonical_url(F.col("url")).alias("url")).filter(U.host_allowed(F.col("url"), options.allowed_hosts)).distinct(), "known")
    frontier, pages, failed, left = known, [], [], options.max_pages
    for depth in range(options.max_depth + 1):
        level, begin = [], 0
        waiting = frontier if left is None else numbered(frontier, "url")
        size = None if left is None else waiting.count()
        while left is None or (left > 0 and begin < size):
            now = waiting if left is None else waiting.filter((F.col("n") >= begin) & (F.col("n") < begin + left)).drop("n")
            got = cut(fetch(now).withColumn("fine", U.serves_html(F.col("status"), F.col("content_type")) & F.coalesce(F.col("body") != "", F.lit(False))), "fetched")
            failed.append(got.filter("NOT fine").select("url", "status", "content_type", F.lit(depth).alias("depth")))
            found = discover(got.filter("fine").select("url", F.col("body").alias("html")))
            found = found.withColumn("canonical", U.canonical_url(F.coalesce("found.canonical", "url"))).withColumn("depth", F.lit(depth))
            level.append(cut(found.select("url", "canonical", "depth", "html", "found"), "pages"))
            if left is None:
                break
            begin, left = begin + left, left - level[-1].count()
        pages += level
        if depth == options.max_depth or left == 0 or not level:
            break
        links = _all(level).select(F.explode("found.links").alias("url")).filter((U.asset_class(F.col("url")) == "page"))
        links = links.select(U.canonical_url(F.col("url")).alias("url")).filter(U.host_allowed(F.col("url"), options.allowed_hosts)).distinct()
        frontier = cut(not_seen(links, known, "url"), "frontier")
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    whole = _all(pages) if pages else discover(known.limit(0).select("url", F.lit("").alias("html"))).select("url", F.col("url").alias("canonical"), F.lit(0).alias("depth"), "html", "found")
    nothing = F.lit(None).cast("string")
    pdfs = whole.select(F.posexplode("found.pdfs").alias("at", "url"), F.lit("pdf").alias("kind"), F.col("canonical").alias("page"), nothing.alias("alt"), nothing.alias("src_hint"), "depth")
    images = whole.select(F.posexplode("found.images").alias("at", "i"), F.col("canonical").alias("page"), "depth").select("at", "i.url", F.lit("image").alias("kind"), "page", "i.alt", "i.src_hint", "depth")
    mentions = pdfs.unionByName(images).withColumn("url", U.canonical_url(F.col("url")))
    assets = keep_first(mentions, "url", ["depth", "page", "kind", "at"]).drop("at", "depth")
    lost = _all(failed) if failed else known.limit(0).select("url", F.lit(0).alias("status"), nothing.alias("content_type"), F.lit(0).alias("depth"))
    return {"pages": whole, "mentions": mentions, "assets": assets, "failed": lost}


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def manifest(pages: DataFrame, assets: DataFrame, at) -> DataFrame:
    """MANIFEST rows of a crawl; at: the time of the run, a Column, so that runs can be repeated."""
    name = F.concat(F.sha1("canonical"), F.lit(".html"))
    p = pages.select(F.lit("page").alias("record"), "url", "canonical", name.alias("html_path"), at.alias("ts"))
    path = asset_path(F.col("url"), F.col("kind"))
    a = assets.select(F.lit("asset").alias("record"), F.col("kind").alias("asset_type"), "url", path.alias("path"), "page", "alt", "src_hint", at.alias("ts"))
    return p.unionByName(a, allowMissingColumns=True)


RAW = "kind string, path string, url string, content binary"


def raw_files(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """RAW rows of pages (canonical, html) and downloaded assets (url, kind, body), under the names that manifest() gives them."""
    p = pages.select(F.lit("html").alias("kind"), F.concat(F.sha1("canonical"), F.lit(".html")).alias("path"), F.col("canonical").alias("url"), F.col("html").cast("binary").alias("content"))
    return p.union(assets.select("kind", asset_path(F.col("url"), F.col("kind")).alias("path"), "url", F.col("body").alias("content")))


def asset_path(url: Column, kind: Column) -> Column:
    return F.concat(F.sha1(url), F.when(kind == "pdf", ".pdf").otherwise(U.extension(url)))


def write_raw(files: DataFrame, path: str) -> None:
    """Adds RAW rows to the store at path: a table of bytes by kind, so that a kind is read without the others."""
    files.write.mode("append").partitionBy("kind").parquet(path)


def read_raw(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, url, content) of one kind, as the extractors take them; of files written twice, one."""
    return spark.read.schema(RAW).parquet(path).filter(F.col("kind") == kind).select("path", "url", "content").dropDuplicates(["path"])
