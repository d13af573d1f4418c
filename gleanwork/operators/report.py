"""Corpus statistics: breakdowns with shares and a total row, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def breakdown(df: DataFrame, by: Column, name: str = "key", digits: int = 2) -> DataFrame:
    """(name, n, share_pct, kind): a row per key, one with kind `unknown` for null keys, and one with kind `total`. Shares are of all rows.

    The names of those two rows are their kinds; a key of that name has kind `key`. One aggregation by key;
    its groups, a row each, are added up for the total.
    """
    groups = cut(df.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n")), "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    kind = F.when(F.col(name).isNull(), "unknown").otherwise("key")
    rows = groups.select(F.coalesce(F.col(name).cast("string"), F.lit("unknown")).alias(name), "n", kind.alias("kind"))
    rows = rows.union(total.select(F.lit("total"), "n", F.lit("total")))
    share = F.round(100.0 * F.col("n") / F.nullif(total.scalar(), F.lit(0)), digits)
    return rows.select(name, "n", share.alias("share_pct"), "kind")


def totals(docs: DataFrame, text: str = "text") -> DataFrame:
    """documents, chars, tokens (a quarter of the characters, rounded up by document), and their averages."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    tokens = F.ceil(n / 4.0).cast("long")
    return docs.agg(
        F.count(F.lit(1)).alias("documents"), F.sum(n).alias("chars"), F.sum(tokens).alias("tokens"),
        F.round(F.avg(n), 1).alias("avg_chars"), F.round(F.avg(tokens), 1).alias("avg_tokens"),
    )
