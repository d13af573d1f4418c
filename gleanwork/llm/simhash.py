"""SimHash near-duplicates, linked by anchor-point covering.

Each half of a 64-bit fingerprint is looked at on its own: if two fingerprints differ in at most
three bits, one half differs in at most one. In a half, 31 of its 32 bits are covered by the perfect
[31, 26] Hamming code: every 31-bit word lies within its covering radius, 1, of exactly one
codeword, its home anchor. A word is replicated to every anchor within covering radius plus the
half's threshold, 1 + 1 = 2: its home and up to 15 more. Whatever lies within one bit of a word is
therefore found at that word's home anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, worker_cache
from .components import components

#: Bit i (1 to 31) of a half has syndrome i; mask k holds the bits whose number has bit k.
CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]
CHUNK = 1 << 16


def digests(text: str | None, shingle: int = 3) -> np.ndarray:
    """The XXH64 of each shingle of one text, repeats included: see fingerprints()."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, 42)], "<u8")
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: n - shingle + 1].tolist()
    stop = end[shingle - 1 :].tolist()
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(start, stop)), "<u8", len(start))


def fingerprint(text: str | None, shingle: int = 3, hashes: np.ndarray | None = None) -> int:
    """The fingerprint of one text, as an unsigned integer: see fingerprints(). hashes: its digests(), where they are there."""
    h = digests(text, shingle) if hashes is None else hashes
    ones, total = np.zeros(64, np.int64), len(h)
    for at in range(0, total, CHUNK):
        ones += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """Signed longs that hold 64-bit fingerprints of whole texts.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are `shingle` words joined
    by a space, repeats included (fewer words: the whole sequence; none or null: zero). A bit is 1 if
    it is set in over half of the shingles' XXH64 (seed 42).
    """

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_cache("simhash")
        for batch in batches:
            yield pd.Series(np.array([fingerprint(x, shingle) for x in batch], np.uint64).view(np.int64))

    return run(text)


def links(prints: DataFrame, col: str = "fingerprint") -> DataFrame:
    """(a, b): all pairs of different fingerprints, a < b, that differ in three bits or fewer, each once or more.

    prints has one row per different fingerprint.
    """
    f = F.col("f")
    halves = prints.select(F.col(col).alias("f")).select("f", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    halves = halves.withColumn("half", F.when(F.col("side") == 0, f.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(f, 32)))
    halves = halves.select("f", "side", F.col("half").bitwiseAND(F.lit((1 << 31) - 1)).alias("w"))
    checks = [(F.bit_count(F.col("w").bitwiseAND(F.lit(mask))) % 2) * (1 << k) for k, mask in enumerate(CHECKS)]
    halves = halves.withColumn("s", sum(checks[1:], checks[0]))  # the syndrome: which bit is off, 0 for codewords
    home = F.when(F.col("s") == 0, F.col("w")).otherwise(F.col("w").bitwiseXOR(F.expr("shiftleft(1L, s - 1)")))
    # Codewords two bits away: flip positions i and i xor s, each such pair once.
    near = F.expr("transform(filter(sequence(1, 31), i -> s > 0 AND i <> s AND i < (i ^ s)), i -> w ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))")
    at_home = halves.select("side", home.alias("anchor"), F.col("f").alias("a"))
    around = halves.select("side", F.explode(F.concat(F.array(home), near)).alias("anchor"), F.col("f").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)
    return at_home.join(around, ["side", "anchor"]).filter(close).select("a", "b")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (long), component_id.

    component_id is the smallest id among the documents that can be reached over links of at most
    three differing bits, the document itself included. With a similarity (above 0, at most 1), texts
    whose sets of shingles have at least this Jaccard similarity are linked as well, whatever their
    fingerprints.

    Only different fingerprints are compared, so groups of copies cost one row. The links and
    components stay distributed; tables that cut the lineage lie in the shared folder.

    Nulls: a null text has fingerprint zero, like a text without words; such rows link like any
    other. Rows with a null id take part, but component_id is the smallest id that is not null (null
    if there is none). Repeated rows give repeated results. An empty table gives no rows; other
    columns of docs are ignored.
    """
    if similarity is None:
        rows = docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), shingle).alias("f"))
    else:
        from . import similar

        rows = similar.prefixes(docs, id_col, text_col, shingle, similarity)
    rows = cut(rows, "prints")
    classes = cut(rows.groupBy("f").agg(F.min("id").alias("rep")), "classes")
    found = cut(links(classes, "f"), "pairs")
    if similarity is not None:
        found = similar.similar_links(docs, rows, found, text_col, shingle, similarity)
    roots = cut(components(found), "roots")
    of = roots.join(classes, roots["node"] == classes["f"]).select("f", "root", "rep")
    least = cut(of.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    merged = of.join(least, "root").select("f", "component_id")
    label = classes.join(merged, "f", "left").select("f", F.coalesce("component_id", "rep").alias("component_id"))
    label = cut(label, "label")
    return rows.join(label, "f").select(F.col("id").alias(id_col), F.col("f").alias("fingerprint"), "component_id")
