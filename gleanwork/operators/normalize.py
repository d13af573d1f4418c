"""Chunks or other text records to embeddable records, with a reason for whatever is left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from ..config import Options
from ..functions.text import strip
from ..functions.tokens import approx_tokens
from ..storage import cut
from .crawl import numbered

TEXT_COLUMNS = ("text", "content", "page_content")


def choose_text(df: DataFrame, text_key: str = "") -> Column:
    """The configured column, else the first of TEXT_COLUMNS that is not null (an empty text counts as found)."""
    names = [c for c in ((text_key,) if text_key else TEXT_COLUMNS) if c in df.columns]
    return F.coalesce(*[F.col(c) for c in names], F.lit("")) if names else F.lit("")


def judged(df: DataFrame, options: Options = Options(), order: str | list[str] = "id", count: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with `embed_text` and `outcome`: kept, filtered, deduped or malformed (a row with a _corrupt_record).

    With dedup by text, the first row of each text in the given order is kept; of rows that are equal in
    it, one. Tokens are counted by `count`, else as options.token_mode says: by characters, or by any
    other mode's name, for which count must be given.
    """
    text = choose_text(df, options.text_key)
    bad = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in df.columns else F.lit(False)
    if count is None and options.min_tokens and options.token_mode != "approx_chars":
        raise ValueError(f"token mode {options.token_mode} needs a tokenizer: give count")
    tokens = count or (lambda t: approx_tokens(t, options.chars_per_token))
    short = strip(text) == ""
    if options.min_chars:
        short = short | (F.length(text) < options.min_chars)
    if options.min_tokens:
        short = short | (tokens(text) < options.min_tokens)
    rows = df.withColumn("embed_text", text).withColumn("outcome", F.when(bad, "malformed").when(short, "filtered").otherwise("kept"))
    if options.dedup == "none":
        return rows
    # Rows get a number that is written, which tells equal ones apart. Only kept ones meet their text's first.
    order = [order] if isinstance(order, str) else order
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "judged")
    kept = rows.filter("outcome = 'kept'").withColumn("_key", F.sha1("embed_text"))
    firsts = kept.groupBy("_key").agg(F.min(F.struct(*order, "_row"))["_row"].alias("_first"))
    kept = kept.join(firsts, "_key").withColumn("outcome", F.when(F.col("_row") == F.col("_first"), "kept").otherwise("deduped"))
    return kept.drop("_key", "_first").select(rows.columns).union(rows.filter("outcome <> 'kept'")).drop("_row")


def embeddable(rows: DataFrame) -> DataFrame:
    """EMBEDDABLE records of the rows that judged() keeps: the url falls back from metadata.source_url to source_url.

    Rows without an id column get their place among all rows, from 1, as their id.
    """
    names = rows.columns
    url = F.coalesce(_in_metadata(rows), F.col("source_url") if "source_url" in names else F.lit(None).cast("string"))
    if "id" not in names:
        rows = rows.withColumn("_at", F.monotonically_increasing_id())
        rows = numbered(rows, "_at", name="_n").withColumn("id", F.col("_n") + 1)
    return rows.filter("outcome = 'kept'").select(F.coalesce(F.col("id").cast("string"), F.lit("None")).alias("id"), F.col("embed_text").alias("text"), F.struct(url.alias("url")).alias("metadata"))


def _in_metadata(rows: DataFrame) -> Column:
    """metadata.source_url where metadata is a map or a struct that has it; null if it is empty or not there."""
    kind = rows.schema["metadata"].dataType if "metadata" in rows.columns else None
    if isinstance(kind, MapType) or isinstance(kind, StructType) and "source_url" in kind.fieldNames():
        return F.nullif(F.col("metadata")["source_url"], F.lit(""))
    return F.lit(None).cast("string")


def counters(rows: DataFrame) -> DataFrame:
    """One row: total, kept, filtered, deduped, malformed."""
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return rows.agg(F.count(F.lit(1)).alias("total"), n("kept"), n("filtered"), n("deduped"), n("malformed"))
