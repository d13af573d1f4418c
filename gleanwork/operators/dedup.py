"""Keep-first deduplication, within a table and against what earlier runs kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import bitset
from ..storage import cut


def keep_first(df: DataFrame, keys: str | list[str], order: str | list[str]) -> DataFrame:
    """Of the rows with equal keys, the one that comes first in the order (which should have no ties). Rows with a null key all stay.

    A partial aggregation keeps one candidate per task and key before the shuffle, so a key that most
    rows share is not gathered in one task, as a window over it would do. For rows that hold texts
    there is keep_first_wide().
    """
    keys, order = [keys] if isinstance(keys, str) else keys, [order] if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min_by(F.struct(*order, *rest) if rest else F.struct(*order), F.struct(*order))
    # A row with a null key is a group of its own, by its place.
    rows = df.withColumn("_own", F.when(~_keyed(keys), F.monotonically_increasing_id()))
    return rows.groupBy(*keys, "_own").agg(first.alias("_first")).select(*keys, "_first.*").select(df.columns)


def keep_first_wide(df: DataFrame, keys: str | list[str], order: str | list[str], bits: int = 1 << 26) -> DataFrame:
    """The same without shuffling whole rows: only keys and order are aggregated, and only rows whose key occurs more than once meet the result.

    df is read more than once, so it should be a table or cheap to compute.
    """
    keys, order = [keys] if isinstance(keys, str) else keys, [order] if isinstance(order, str) else order
    keyed = _keyed(keys)
    groups = df.filter(keyed).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    shared = cut(groups.filter("_n > 1").select(*keys, "_first"), "shared")
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    many = keyed & F.coalesce(bitset.has(bitset.build(shared, at, bits), at), F.lit(False))
    firsts = df.filter(many).join(shared, keys, "left").filter(F.col("_first").isNull() | (F.struct(*order) == F.col("_first")))
    return df.filter(~many).union(firsts.select(df.columns).dropDuplicates(keys))


def _keyed(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def known_hashes(df: DataFrame, columns: tuple[str, ...] = ("content_hash", "sha1", "content_sha1", "hash"), least: int = 8) -> DataFrame:
    """content_hash of each row of an earlier result: the first usable of these columns, of at least so many characters."""
    there = [F.when(F.length(c) >= least, F.col(c)) for c in columns if c in df.columns]
    if not there:
        return df.sparkSession.range(0).select(F.lit("").alias("content_hash"))
    return df.select(F.coalesce(*there).alias("content_hash")).filter("content_hash IS NOT NULL").distinct()


def not_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key earlier runs have not kept; null keys pass."""
    return df.join(seen.select(key), key, "left_anti")


def dedup_incremental(df: DataFrame, seen: DataFrame | None, key: str, order: str | list[str], scope: str | Column | None = None) -> DataFrame:
    """New keys only, each once. scope: a column within which alone keys are compared (and nothing earlier counts)."""
    if scope is not None:
        rows = df.withColumn("_scope", F.coalesce(F.col(scope) if isinstance(scope, str) else scope, F.lit("")))
        return keep_first_wide(rows, ["_scope", key], order).drop("_scope")
    return keep_first_wide(not_seen(df, seen, key) if seen is not None else df, key, order)
