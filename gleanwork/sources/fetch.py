"""Fetching as an injected connector: the engine never opens a connection itself."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import url as U
from ..operators.dedup import keep_first, not_seen
from ..storage import cut

#: In which the mentions of an asset are tried.
ORDER = ["depth", "page", "kind", "at"]


class Fetcher(Protocol):
    def __call__(self, url: str) -> tuple[int | None, str | None, str | None]:
        """(status, content type, body); raises or gives no status on failure."""


class BinaryFetcher(Protocol):
    def __call__(self, url: str, headers: dict[str, str]) -> tuple[int | None, str | None, bytes | None]:
        """(status, content type, bytes); raises or gives no status on failure."""


class Slots:
    """Times at which the calls of each host may begin, at least 1 / rate seconds apart; rates below 0.1 count as 0.1."""

    def __init__(self, rate: float) -> None:
        self.gap = 1 / max(0.1, rate)
        self.free: dict[str, float] = {}

    def book(self, host: str, now: float) -> float:
        """Seconds to wait for the host's next slot, which is then taken."""
        begin = max(now, self.free.get(host, now))
        self.free[host] = begin + self.gap
        return begin - now


def _called(make: Callable[[], Callable], rate: float, arguments: Callable[[tuple], tuple]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over (url, host, more...): the rows' columns but host, with what the connector says of each; nulls on failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, slots = make(), Slots(rate)
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                time.sleep(slots.book(row.host or "", time.monotonic()))
                try:
                    rows.append(get(*arguments(row)))
                except Exception:  # noqa: BLE001  any failure of a connector is a page that isn't there
                    rows.append((None, None, None))
            out = pdf.drop(columns="host").reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=["status", "content_type", "body"]).astype({"status": "Int32"})], axis=1)

    return run


def fetch_all(make: Callable[[], Fetcher], rate: float = 2.0) -> Callable[[DataFrame], DataFrame]:
    """(url) -> FETCHED rows. Hosts are dealt out, so that one task alone calls a host and keeps its rate. Failures give a null status."""
    run = _called(make, rate, lambda row: (row.url,))
    return lambda urls: urls.select("url", U.host(F.col("url")).alias("host")).repartition("host").mapInPandas(run, S.FETCHED)


def download(references: DataFrame, make: Callable[[], BinaryFetcher], rate: float = 2.0, seen: DataFrame | None = None, attempts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fetches assets as bytes: (what was got, what failed at last).

    references: a row for each mention, url, kind, page, alt, src_hint and the columns of ORDER. Each
    url is fetched for its first mention, the page being the referer; what fails is tried again for
    its next one, for all of them or `attempts` in all. seen: urls (url) that earlier runs have; they
    are left out. Only status 200 counts. Got: url, kind, page, alt, src_hint, status, content_type,
    body; failed: the same columns of every attempt on urls that were never got, without body.
    """
    rows = references if seen is None else not_seen(references, seen, "url")
    waiting = cut(rows.filter("url IS NOT NULL").distinct(), "mentions")
    columns = ["url", "kind", "page", "alt", "src_hint"]
    schema = "url string, kind string, page string, alt string, src_hint string, status int, content_type string, body binary"
    run = _called(make, rate, lambda row: (row.url, {"Referer": row.page} if row.page else {}))
    got = failed = cut(references.sparkSession.createDataFrame([], schema), "assets")
    done = 0
    while (attempts is None or done < attempts) and not waiting.isEmpty():
        now = keep_first(waiting, "url", ORDER)
        tried = cut(now.select(*columns, U.host(F.col("url")).alias("host")).repartition("host").mapInPandas(run, schema), "assets")
        fine = F.coalesce(F.col("status") == 200, F.lit(False)) & F.col("body").isNotNull()
        got, failed = got.union(tried.filter(fine)), failed.union(tried.filter(~fine))
        rest = not_seen(waiting, tried.filter(fine), "url")
        waiting = cut(rest.join(now.select("url", *ORDER), ["url", *ORDER], "left_anti").select(waiting.columns), "mentions")
        done += 1
    return got, not_seen(failed, got, "url").drop("body")


def fetch_from(bodies: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The same from a table (url, body and perhaps status, content_type), for replays and tests: urls that it lacks fail."""
    status = F.col("status") if "status" in bodies.columns else F.lit(200)
    kind = F.col("content_type") if "content_type" in bodies.columns else F.lit("text/html")
    there = bodies.select(U.canonical_url(F.col("url")).alias("url"), status.cast("int").alias("status"), kind.alias("content_type"), "body").dropDuplicates(["url"])
    return lambda urls: urls.select("url").join(there, "url", "left")
