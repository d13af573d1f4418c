"""Bitsets of fixed size, built and probed with SQL functions only.

A bitset is a one-row table of blocks of 512 longs, so its size is known before anything is computed
and does not grow with the data. It reaches other rows as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

BLOCK, SHIFT = 1 << 15, 15  # bits that bitmap_construct_agg() holds
MAX_BITS = 1 << 30


def checked_bits(bits: int) -> int:
    """bits, rounded up to whole blocks; ValueError beyond 128 MB."""
    if not 0 < bits <= MAX_BITS:
        raise ValueError(f"a bitset may have 1 to {MAX_BITS} bits, not {bits}")
    return -(-bits // BLOCK) * BLOCK


def fitting(table: DataFrame, most: int) -> int:
    """Bits for the rows of a written table: about sixteen to thirty-two for each, a power of two, at most `most`."""
    return min(most, 1 << max(17, (16 * table.count()).bit_length()))


def build(df: DataFrame, positions: Column, bits: int) -> DataFrame:
    """A table of one row and one column, blocks: array<array<long>>, with the bits at the given positions (longs in [0, bits); null: none)."""
    bits = checked_bits(bits)
    spark = df.sparkSession
    at = df.select(positions.alias("at")).select(F.shiftright("at", SHIFT).alias("block"), F.col("at").bitwiseAND(F.lit(BLOCK - 1)).alias("bit"))
    blank = spark.range(bits // BLOCK).select(F.col("id").alias("block"), F.lit(None).cast("long").alias("bit"))
    blocks = at.filter(F.col("bit").isNotNull()).union(blank).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    eight = lambda i: F.conv(F.hex(F.substring(F.col("bitmap"), i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    words = blocks.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), eight).alias("words"))
    rows = F.sort_array(F.collect_list(F.struct("block", "words")))
    return cut(words.agg(F.transform(rows, lambda x: x["words"]).alias("blocks")), "bitset")


def has(bitset: DataFrame | Column, position: Column) -> Column:
    """Whether the bit at the position (a long in [0, bits)) is set; bitset: its table, or a column with its blocks."""
    block = F.get(bitset if isinstance(bitset, Column) else bitset.scalar(), F.shiftright(position, SHIFT).cast("int"))
    word = F.get(block, F.shiftright(position, 6).bitwiseAND(F.lit(BLOCK // 64 - 1)).cast("int"))
    # A word's bytes are in the order of its positions, the first being the highest.
    place = position.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56)).cast("int")
    return F.call_function("shiftright", word, place).bitwiseAND(F.lit(1)) == 1
