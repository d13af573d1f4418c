"""robots.txt and sitemaps, given as tables of fetched texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import host_allowed
from ..operators.dedup import not_seen
from ..storage import cut

#: Where sitemaps are if robots.txt doesn't say.
DEFAULTS = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml")
CAP = 20_000


def robots_sitemaps(text: Column) -> Column:
    """array<string>: what follows the colon of every Sitemap line."""
    lines = F.filter(F.split(text, r"\r?\n|\r"), lambda x: F.lower(F.trim(x)).startswith("sitemap:"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))), lambda u: u != "")


def discover_sitemaps(robots: DataFrame, defaults: tuple[str, ...] = DEFAULTS) -> DataFrame:
    """(origin, url), each once: what robots.txt (origin, body) names, and the default places."""
    named = robots.select("origin", F.explode(robots_sitemaps(F.coalesce("body", F.lit("")))).alias("url"))
    return named.union(robots.select("origin", F.explode(F.array(*[F.concat(F.col("origin"), F.lit(d)) for d in defaults])))).distinct()


def locations(xml: Column, hosts: tuple[str, ...] | None = None, cap: int = CAP) -> Column:
    """array<string>: the first allowed locations of a sitemap; none if the text has no tag."""
    found = F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)<loc>(.*?)</loc>"), F.lit(1)), lambda u: F.regexp_replace(u, r"^\s+|\s+$", ""))
    return F.slice(F.filter(found, lambda u: host_allowed(u, hosts)) if hosts is not None else found, 1, cap)


def expand(starts: DataFrame, bodies: DataFrame | Callable[[DataFrame], DataFrame], hosts: tuple[str, ...] | None = None, cap: int = CAP) -> DataFrame:
    """(url): the pages that sitemaps lead to, nested sitemaps (.xml) being followed, each once. bodies: url, body, or what fetches these for urls; cap: see locations().

    Ends when a round finds no new sitemap, which it does at last, as each is followed once.
    """
    nested = F.lower("url").endswith(".xml")
    waiting = cut(starts.select("url").filter(nested).distinct(), "sitemaps")
    leaves = starts.select("url").filter(~nested)
    known = waiting
    while not waiting.isEmpty():
        read = bodies(waiting) if callable(bodies) else waiting.join(bodies, "url")
        found = cut(read.select(F.explode(locations(F.col("body"), hosts, cap)).alias("url")), "locations")
        leaves = leaves.union(found.filter(~nested))
        waiting = cut(not_seen(found.filter(nested).distinct(), known, "url"), "sitemaps")
        known = known.union(waiting)
    return leaves.distinct()
