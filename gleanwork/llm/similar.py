"""Links between texts whose sets of shingles have a Jaccard similarity of at least a limit; none is lost.

Prefix filter: with all sets in one order, two that reach the limit share one of the first
n - ceil(limit n) + 1 shingles of each. The order is that of the hashes, with the shingles that are
frequent in a sample of the documents last, so that common passages make few candidates (the order
never changes what is found). Candidates that share a shingle are verified against the least text
with that shingle first; what is connected by then needs no further comparison, so a large group of
near copies costs a row per text and shingle, not per pair. Before any set is read, the parities of
two sets' hashes refuse most pairs that can't reach the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import bitset
from .common import col, cut, drop_cut, worker_cache
from .components import components
from .simhash import digests, fingerprint

FILTER_BITS = 1 << 26
SAMPLE = 8_000  # documents in which frequent shingles are looked for
FREQUENT, MOST_FREQUENT = 6, 200_000  # documents of the sample that make a shingle frequent; so many are set last


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different shingles' hashes, ascending; see simhash.fingerprints() for shingles."""
    return np.unique(digests(text, shingle)).view(np.int64)


def parities(s: np.ndarray) -> np.ndarray:
    """Bits as longs, twice to four times as many as there are hashes: whether an odd number of them falls to each.

    What two sets don't share is at least the bits in which theirs differ. Half as many bits are those of the two halves together.
    """
    size = 1 << max(8, (2 * len(s)).bit_length())
    odd = np.bincount(s & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _least(n: int | Column, similarity: float) -> int | Column:
    """How many shingles of a set of n another one shares at least."""
    return int(np.ceil(similarity * n - 1e-9)) if isinstance(n, int) else F.ceil(n * similarity - 1e-9)


def frequent(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> np.ndarray:
    """Shingles of many of the sampled documents, ascending."""
    total = docs.count()
    some = docs if total <= SAMPLE else docs.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < F.lit((SAMPLE << 20) // total))

    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(t, shingle) for t in batch])

    counts = some.select(F.explode(sets(F.col(text_col))).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).select("s").toPandas()["s"]
    return np.sort(found.to_numpy(np.int64))


def prefixes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, f, t, n, prefix, bits) per row of docs: fingerprint, the text's hash, its number of different shingles, the first of them, and the parities of all."""
    late = docs.sparkSession.sparkContext.broadcast(frequent(docs, id_col, text_col, shingle))

    @F.pandas_udf("f long, n long, prefix array<long>, bits array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_cache("similar")
        for batch in batches:
            out = []
            for t in batch:
                own = digests(t, shingle)
                s = np.unique(own).view(np.int64)
                k = len(s) - _least(len(s), similarity) + 1 if len(s) else 0
                bits = parities(s)
                if len(late.value):
                    seen = late.value[np.searchsorted(late.value[:-1], s)] == s
                    s = np.concatenate([s[~seen], s[seen]])
                out.append((np.array([fingerprint(t, shingle, own)], np.uint64).view(np.int64)[0], len(s), s[:k], bits))
            yield pd.DataFrame(out, columns=["f", "n", "prefix", "bits"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), run(F.col(text_col)).alias("found"))
    return rows.select("id", "t", "found.*")


def not_refused(rows: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (ta, tb, fa, fb) whose parities don't show already that the texts can't reach the similarity. A written table."""
    sides = rows.groupBy("t").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("bits"))
    a, b = sides.toDF("ta", "na", "ba"), sides.toDF("tb", "nb", "bb")
    both = pairs.join(a.hint("merge"), "ta").join(b.hint("merge"), "tb")

    def halved(bits: Column, size: Column) -> Column:
        """bits, or their halves together if they are more than size: lengths of pairs differ too little for more."""
        half = F.zip_with(F.slice(bits, 1, size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) > size, half).otherwise(bits)

    size = F.least(F.size("ba"), F.size("bb"))
    differ = F.zip_with(halved(F.col("ba"), size), halved(F.col("bb"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(differ, F.lit(0), lambda s, x: s + x)
    return cut(both.filter(apart <= (F.col("na") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + 1e-6).select(pairs.columns), "candidates")


def verified(docs: DataFrame, pairs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(a, b): the fingerprints of those pairs (ta, tb, fa, fb) whose texts reach the similarity."""

    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(t, shingle) for t in batch])

    wanted = cut(pairs.select(F.col("ta").alias("t")).union(pairs.select("tb")).distinct(), "wanted")
    # Only texts that may be wanted are shuffled.
    bits = bitset.fitting(wanted, FILTER_BITS)
    at = F.pmod("t", F.lit(bits))
    chosen = bitset.build(wanted, at, bits)
    texts = docs.select(F.xxhash64(col(text_col)).alias("t"), col(text_col).alias("text")).filter(bitset.has(chosen, at)).join(wanted.hint("merge"), "t", "left_semi")
    held = cut(texts.groupBy("t").agg(F.any_value("text").alias("text")).select("t", sets(F.col("text")).alias("s")), "sets")
    both = pairs.join(held.toDF("ta", "sa"), "ta").join(held.toDF("tb", "sb"), "tb")
    shared = F.size(F.array_intersect("sa", "sb"))
    close = shared >= similarity * (F.size("sa") + F.size("sb") - shared) - 1e-9
    out = cut(both.filter(close).select(F.col("fa").alias("a"), F.col("fb").alias("b")).filter("a <> b").distinct(), "similar")
    for old in (held, wanted, chosen):
        drop_cut(old)
    return out


def similar_links(docs: DataFrame, rows: DataFrame, near: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) of fingerprints that, with those in near, connect all texts of at least the similarity.

    rows: prefixes(docs, ...), written.
    """
    tokens = rows.select("t", "f", "n", F.posexplode("prefix").alias("i", "s"))
    # Most shingles are one text's alone. Which may not be is found from 32 bits of their hashes, and kept as a bitset.
    small = tokens.select(F.hash("s").alias("s"), "t")
    common = cut(small.groupBy("s").agg(F.min("t").alias("p"), F.max("t").alias("q")).filter("p <> q").select("s"), "common")
    bits = bitset.fitting(common, FILTER_BITS)
    chosen = bitset.build(common, F.pmod(F.xxhash64("s"), F.lit(bits)), bits)
    shared = tokens.filter(bitset.has(chosen, F.pmod(F.xxhash64(F.hash("s")), F.lit(bits))))
    shared = cut(shared.distinct(), "tokens")
    least = shared.groupBy("s").agg(F.min("t").alias("p"), F.max("t").alias("q")).filter("p <> q").select("s", "p")
    held = cut(shared.join(least.hint("merge"), "s").select("s", "t", "f", "n", "i", "p"), "held")
    for old in (common, chosen, shared):
        drop_cut(old)
    me = F.struct("t", "f", "n", "i")
    pivots = held.filter("t = p").select("s", me.alias("p"))
    shared = cut(held.select("s", me.alias("me")).join(pivots, "s"), "shared")
    drop_cut(held)

    def may(x: str, y: str) -> Column:
        """Whether two texts can reach the similarity, by their lengths and what is left after the first common shingle."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        left = 1 + F.least(n - F.col(f"{x}.i"), m - F.col(f"{y}.i")) - 1
        return (F.least(n, m) >= _least(F.greatest(n, m), similarity)) & (left >= F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9))

    def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
        return not_refused(rows, df.select(F.col(f"{x}.t").alias("ta"), F.col(f"{y}.t").alias("tb"), F.col(f"{x}.f").alias("fa"), F.col(f"{y}.f").alias("fb")).distinct(), similarity)

    first = verified(docs, pairs(shared.filter("me.t <> p.t AND me.f <> p.f").filter(may("me", "p")), "me", "p"), text_col, shingle, similarity)
    known = near.union(first)
    root = cut(components(known), "roots")
    others = shared.filter("me.t <> p.t").select("s", "me", F.col("me.f").alias("node")).join(root, "node", "left")
    others = others.select("s", "me", F.coalesce("root", "node").alias("r"))
    a, b = others.toDF("s", "x", "rx"), others.toDF("s", "y", "ry")
    second = verified(docs, pairs(a.join(b, "s").filter(F.col("rx") < F.col("ry")).filter(may("x", "y")), "x", "y"), text_col, shingle, similarity)
    drop_cut(shared)
    return known.union(second)
