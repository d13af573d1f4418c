"""URL functions: Column -> Column, built in except where a URL is resolved against a base."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that only track visitors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "_gl", "ref")
#: What an href may not start with.
UNFOLLOWED = ("#", "mailto:", "tel:", "javascript:", "data:")
#: What PDFs, pictures and pages are told by.
PDF = r"(?i)\.pdf(?:[?#].*)?$"
IMAGE = r"(?i)\.(?:png|jpe?g|webp|gif|bmp|tiff?)(?:[?#].*)?$"
HTML_TYPES = ("", "text/html", "application/xhtml+xml", "text/plain")
#: Characters that stand plainly in a path.
PLAIN = r"[A-Za-z0-9._~:/\[\]@!$&'()*+,;=|%-]"
#: Scheme, authority, path, query; a fragment is left out.
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    """The host, lower-cased, without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_allowed(url: Column, hosts: Iterable[str]) -> Column:
    """Whether the url's host is one of a short list of hosts or a subdomain of one."""
    h = F.coalesce(host(url), F.lit(""))
    out = F.lit(False)
    for x in hosts:
        out = out | (h == x) | h.endswith(f".{x}")
    return out


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")


def is_pdf(url: Column) -> Column:
    return F.coalesce(url.rlike(PDF), F.lit(False))


def is_image(url: Column) -> Column:
    return F.coalesce(url.rlike(IMAGE), F.lit(False))


def asset_class(url: Column) -> Column:
    return F.when(is_pdf(url), "pdf").when(is_image(url), "image").otherwise("page")


def extension(url: Column, default: str = ".bin") -> Column:
    """The path's extension with its dot, in lower case."""
    found = F.lower(F.regexp_extract(F.regexp_extract(url, _PARTS, 3), r"(\.[^./]+)$", 1))
    return F.when(found == "", default).otherwise(found)


def mime(content_type: Column) -> Column:
    """What stands before the first semicolon, trimmed and in lower case."""
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def serves_html(status: Column, content_type: Column) -> Column:
    return status.isNotNull() & (status < 400) & mime(F.coalesce(content_type, F.lit(""))).isin(*HTML_TYPES)


def _decoded(text: Column) -> Column:
    """text with its escapes resolved; as it is where one of them is malformed."""
    return F.coalesce(F.try_url_decode(text), text)


def _escaped_path(path: Column) -> Column:
    """Escapes in one form: what may stand plainly does, all else is escaped by its UTF-8 bytes in upper case; %2F and %3F stay."""
    kept = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "(?i)%2f", "%252F"), "(?i)%3f", "%253F")
    plain = F.when(F.contains(path, F.lit("%")), F.when(F.try_url_decode(kept).isNotNull(), F.try_url_decode(kept)).otherwise(path)).otherwise(path)
    one = lambda c: F.when(c.rlike(PLAIN), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1"))
    return F.when(plain.rlike(f"^(?:{PLAIN})*$"), plain).otherwise(F.array_join(F.transform(F.split(plain, ""), one), ""))


def _escaped_value(text: Column) -> Column:
    """A name or value of a query in the form that HTML forms send."""
    return F.replace(F.replace(F.url_encode(_decoded(text)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column, keep: Iterable[str] | None = None, drop: Iterable[str] = (), force_https: bool = True) -> Column:
    """The url in a normal form.

    http becomes https; scheme and host are lower-cased; the fragment goes; parameters are sorted by
    name and value, of equal names the first stays, and tracking parameters and those to drop go (or,
    if `keep` is given, all but those); an empty path is /, and a last index.html or index.htm goes.
    Escapes in path and parameters are brought into one form. What is no absolute url stays as it is.
    """
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    scheme = F.lower(part(1))
    if force_https:
        scheme = F.when(scheme == "http", "https").otherwise(scheme)
    # User information is case-sensitive, what follows it is not.
    authority = F.concat(F.regexp_extract(part(2), r"^([^@]*@)?", 1), F.lower(F.regexp_replace(part(2), r"^[^@]*@", "")))
    path = F.regexp_replace(_escaped_path(F.when(part(3) == "", "/").otherwise(part(3))), r"/index\.html?$", "/")
    name = lambda p: _escaped_value(F.split_part(p, F.lit("="), F.lit(1)))
    value = lambda p: _escaped_value(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(""))
    pairs = F.transform(F.array_remove(F.split(part(4), "&"), ""), lambda p: F.struct(name(p).alias("k"), value(p).alias("v")))
    names = list(keep) if keep else [*TRACKING, *drop]
    wanted = (lambda p: p["k"].isin(names)) if keep else (lambda p: ~p["k"].isin(names))
    pairs = F.array_sort(F.filter(pairs, wanted))
    firsts = F.filter(pairs, lambda p, i: (i == 0) | (p["k"] != F.get(pairs, i - 1)["k"]))
    query = F.array_join(F.transform(firsts, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    whole = F.concat(scheme, F.lit("://"), authority, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(_PARTS), whole).otherwise(url)


def followable(href: Column) -> Column:
    """Whether an href leads anywhere: not empty, no fragment alone, no unfollowed scheme."""
    h = F.trim(href)
    out = h.isNotNull() & (h != "")
    for x in UNFOLLOWED:
        out = out & ~h.startswith(x)
    return out


@F.pandas_udf(StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b: str | None, h: str | None) -> str | None:
        try:
            return urljoin(b or "", h) if h else None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype="object")


def safe_join(base: Column, href: Column) -> Column:
    """href resolved against base; null if it leads nowhere or can't be resolved."""
    return _joined(base, F.when(followable(href), F.trim(href)))


def srcset_urls(srcset: Column) -> Column:
    """The candidates' urls."""
    return F.filter(F.transform(F.split(srcset, ","), lambda p: F.split_part(F.trim(p), F.lit(" "), F.lit(1))), lambda u: u != "")


def css_url(style: Column) -> Column:
    """The first url(...) of a style, without quotes; null if there is none."""
    return F.nullif(F.regexp_extract(style, r"""url\(\s*['"]?([^)'"]+?)['"]?\s*\)""", 1), F.lit(""))
