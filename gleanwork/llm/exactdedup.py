"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import bitset
from .common import SPACES, cut

#: Bits of the two filters between the levels: 8 MB each whatever the corpus. Fuller filters only let more rows through to the next level.
FILTER_BITS = 1 << 26
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, filter_bits: int = FILTER_BITS, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, and the extra columns.

    Rows are equal when their normalised texts are. Of equal rows, the one with the most code points
    in its original text stays, then the smallest id.

    Level 1 groups all rows by normalised length, level 2 what survives by the hash of a prefix, and
    level 3 reads and hashes (SHA-256) the full content of rows whose length and prefix hash occur
    more than once. Each level hands the next a bitset of its surviving groups, whose size is fixed,
    so no text is shuffled. All grouping is partial before each shuffle; the join that gives rows
    their group's result has a row per group on one side, so Spark splits a hot group's rows.

    Nulls: a null text is empty; empty texts are equal to one another. A null id sorts after all
    others; if all ids of a group are null, keep_id is null and all its rows stay. Repeated rows
    (equal id and text) all stay when their id is the one that stays, and each counts in group_size.
    An empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    text = F.col(text_col)
    size = F.length(normalised(text)).cast("long")
    prefix = F.xxhash64(F.substring(normalised(text), 1, prefix_chars))
    sketch = cut(docs.select(size.alias("len"), prefix.alias("prefix")), "sketch")

    at_length = lambda n: F.pmod(F.xxhash64(n), F.lit(filter_bits))
    at_prefix = lambda n, p: F.pmod(F.xxhash64(n, p), F.lit(filter_bits))
    lengths = sketch.groupBy("len").count().filter("count > 1")
    shared_length = bitset.build(lengths, at_length(F.col("len")), filter_bits)
    prefixes = sketch.filter(bitset.has(shared_length, at_length(F.col("len")))).groupBy("len", "prefix").count().filter("count > 1")
    shared_prefix = bitset.build(prefixes, at_prefix(F.col("len"), F.col("prefix")), filter_bits)

    survives = bitset.has(shared_prefix, at_prefix(size, prefix))
    full = F.unhex(F.sha2(normalised(text), 256))
    rows = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            F.when(survives, full).alias("_hash"),
            F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_chars"),
            *[c.alias(f"_x_{k}") for k, c in (extra or {}).items()],
        ),
        "hashed",
    )
    best = F.min(F.struct((-F.col("_chars")).alias("chars"), F.col("_id").isNull().alias("none"), F.col("_id").alias("keep_id")))
    groups = rows.filter("_hash IS NOT NULL").groupBy("_hash").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = cut(groups.select("_hash", "best.keep_id", "group_size"), "groups")
    # A row without a full hash gets a key of its own, else all of them would meet in one task.
    own = F.coalesce(F.col("_hash"), F.unhex(F.lpad(F.hex(F.xxhash64("_id")), 16, "0")))
    out = rows.withColumn("_key", own).join(groups.withColumnRenamed("_hash", "_key"), "_key", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        *[F.col(f"_x_{k}").alias(k) for k in extra or {}],
    )
