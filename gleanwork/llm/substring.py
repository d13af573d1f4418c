"""Substring deduplication by level-wise doubling of repeated word windows.

The lengths double up to the window's: 7, then 13 for windows of 13 words. At the first length only
minimisers are looked at: of the first-length windows in every window of the next length, the one
with the smallest hash. They depend on content alone, so a repeated longer window always has a
repeated minimiser, and a quarter of all positions is enough. Only windows that are repeated at one
length are extended to the next; the levels end when no candidate survives or the full length is
reached. Per level, rows of (hash, document) are shuffled; copies of a hash within a task are combined
before the shuffle, so a passage that every document has costs a row or so per task. Texts are
shuffled only to meet their own document's candidates, and only those of documents that have some.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bitset
from .common import cut, worker_cache

FIRST = 5  # the shortest first length
FLUSH = 1 << 20  # windows that a task combines at once
CACHE = 1 << 18  # words whose hashes a worker remembers
FILTER_BITS = 1 << 26  # of the filter that spares the texts of documents without candidates a shuffle
B1, B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def lengths(window: int) -> list[int]:
    """The levels' window lengths, each at most twice the one before: [7, 13] for 13."""
    out = [window]
    while (half := -(-out[0] // 2)) >= FIRST:
        out.insert(0, half)
    return out


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    held = worker_cache("substring")
    if "hashes" not in held:
        held["hashes"] = _Hashes()
    return np.fromiter(map(held["hashes"].__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Hashes of all windows of this many words: polynomials in base, doubled step by step, then mixed."""
    with np.errstate(over="ignore"):
        out, n, power = h, 1, base
        while n < length:
            step = min(n, length - n)  # windows of n + step words: the first n, and the last n overlapping
            if step == n:
                out = out[:-n] * power + out[n:] if len(out) > n else out[:0]
                power = power * power
            else:
                out = out[:-step] * base + out[step:] * np.uint64(0xA24BAED4963EE407) if len(out) > step else out[:0]
            n += step
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return out ^ (out >> np.uint64(29))


def minimisers(first: np.ndarray, per_window: int) -> np.ndarray:
    """For every window of per_window consecutive hashes, the position of the smallest (the first of equal ones)."""
    n = len(first) - per_window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(first, per_window).argmin(axis=1) + np.arange(n)


def _windows(text: str | None, sizes: list[int], level: int, alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of one text's candidates at a level, each once; alive: hashes that survived the level before."""
    h = word_hashes(words_of(text))
    if level == 0:
        one = rolled(h, sizes[0], B1)
        if len(sizes) > 1:
            one = one[np.unique(minimisers(one, sizes[1] - sizes[0] + 1))]
            return (u := np.unique(one)), u
        at = np.arange(len(one))
    elif level == 1:
        before = rolled(h, sizes[0], B1)
        at = np.flatnonzero(np.isin(before[minimisers(before, sizes[1] - sizes[0] + 1)], alive))
    else:
        ok = np.isin(rolled(h, sizes[level - 1], B1), alive)
        n = max(0, len(h) - sizes[level] + 1)
        at = np.flatnonzero(ok[:n] & ok[sizes[level] - sizes[level - 1] :][:n])
    one, two = rolled(h, sizes[level], B1)[at], rolled(h, sizes[level], B2)[at]
    _, first = np.unique(one, return_index=True)
    return one[first], two[first]


#: h, g: the hashes. doc: the id. state: 0 must be compared with other tasks' rows, 1 is known to be repeated, 2 both.
ROWS = "h long, g int, doc long, state byte"


def _emit(sizes: list[int], level: int, last: bool, text_col: str, alive_col: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def combined(h: list[np.ndarray], g: list[np.ndarray], d: list[np.ndarray]) -> pa.RecordBatch:
        one, two, doc = np.concatenate(h), np.concatenate(g).astype(np.uint32), np.concatenate(d)
        order = np.lexsort((doc, two, one))
        one, two, doc = one[order], two[order], doc[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        starts = np.flatnonzero(new)
        least = doc[starts][np.cumsum(new) - 1] if len(one) else doc
        most = doc[np.append(starts[1:], len(doc)) - 1] if len(one) else doc
        cross = (most > doc[starts])[np.cumsum(new) - 1] if len(one) else new
        # The hash's smallest document goes on to other tasks; the rest is known to be repeated.
        state = np.where(new, np.where(cross & (not last), 2, 0), np.where(doc > least, 1, 3)).astype(np.int8)
        keep = state < 3
        return pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)[keep]), pa.array(two.view(np.int32)[keep]), pa.array(doc[keep]), pa.array(state[keep])], ["h", "g", "doc", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, g, d, n = [], [], [], 0
        for batch in batches:
            alive = batch.column(alive_col) if alive_col else None
            for i, (doc, text) in enumerate(zip(batch.column("_doc").to_pylist(), batch.column(text_col))):
                old = None if alive is None else _longs(alive[i])
                if doc is None or alive is not None and not len(old):
                    continue
                one, two = _windows(text.as_py(), sizes, level, old)
                h.append(one), g.append(two), d.append(np.full(len(one), doc, np.int64))
                if (n := n + len(one)) >= FLUSH:
                    yield combined(h, g, d)
                    h, g, d, n = [], [], [], 0
        if n:
            yield combined(h, g, d)

    return run


def _meet(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by (h, g, doc): the hashes that are repeated in different documents, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None  # the hash that may go on in the next batch, its first document, whether that is out
        for batch in batches:
            h, g, doc, state = (batch.column(k).to_numpy() for k in ("h", "g", "doc", "state"))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            group, first = np.cumsum(new) - 1, doc[new]
            goes_on = open_ is not None and open_[:2] == (h[0], g[0])
            if goes_on:
                first = np.append(open_[2], first[1:])
            later = doc > first[group]
            if last:
                good = (state == 1) | later
            else:
                more = np.zeros(len(first), bool)
                more[group[later]] = True
                good = (state != 0) | more[group]
                if goes_on and more[0] and not open_[3]:
                    yield pa.RecordBatch.from_arrays([pa.array([open_[2]], pa.int64()), pa.array([open_[0]], pa.int64())], ["doc", "h"])
                out = bool(more[-1]) or (bool(open_[3]) if goes_on and len(first) == 1 else bool(state[np.flatnonzero(new)[-1]] != 0))
                open_ = (h[-1], g[-1], first[-1], out)
            if last:
                open_ = (h[-1], g[-1], first[-1], True)
            yield pa.RecordBatch.from_arrays([pa.array(doc[good]), pa.array(h[good])], ["doc", "h"])

    return run


def _repeated(texts: DataFrame, sizes: list[int], level: int, text_col: str, alive_col: str | None) -> DataFrame:
    """(doc, alive): per document, the candidate hashes of a level that other documents have too; at the last level, that smaller documents have."""
    last = level == len(sizes) - 1
    rows = texts.mapInArrow(_emit(sizes, level, last, text_col, alive_col), ROWS)
    # Rows that are settled go anywhere; the others meet by hash. Rows that are both go by hash: one a task.
    key = F.when(F.col("state") == 1, F.xxhash64("doc", "h")).otherwise(F.col("h"))
    met = rows.withColumn("key", key).repartition("key").sortWithinPartitions("h", "g", "doc").drop("key").mapInArrow(_meet(last), "doc long, h long")
    return cut(met.groupBy("doc").agg(F.collect_list("h").alias("alive")), "alive")


def _longs(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy().view(np.uint64) if value.is_valid else np.zeros(0, np.uint64)


def repeated_words(text: str | None, hashes: np.ndarray, window: int) -> tuple[list[bytes], np.ndarray]:
    """The text's words, and which of them windows with these hashes cover."""
    words = words_of(text)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(hashes) and len(words) >= window:
        at = np.flatnonzero(np.isin(rolled(word_hashes(words), window, B1), hashes))
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    return words, np.cumsum(covered)[:-1] > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, texts: bool = False, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_sha256, and with texts the kept text.

    Words are runs without ASCII white space, unchanged. Each word is removed that is covered by a
    window of consecutive words whose sequence also starts in a document with a smaller id; windows
    are judged on the input. The kept words are joined by one space.

    Nulls: a null text has no words. A row with a null id neither loses words nor makes others lose
    them. Rows that share an id are one document, even with different texts. An empty table gives no
    rows; other columns of docs are ignored. Texts of any length are read whole.
    """
    sizes = lengths(window)
    base = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    spot = F.pmod(F.xxhash64("_doc"), F.lit(filter_bits))

    def joined(alive: DataFrame, everyone: bool) -> DataFrame:
        """base with each document's hashes. Documents that the filter rules out don't enter the join."""
        chosen = bitset.build(alive, F.pmod(F.xxhash64("doc"), F.lit(filter_bits)), filter_bits)
        maybe = F.col("_doc").isNotNull() & bitset.has(chosen, spot)
        with_any = base.filter(maybe).join(alive.withColumnRenamed("doc", "_doc"), "_doc", "left" if everyone else "inner")
        if everyone:
            return with_any.unionByName(base.filter(~maybe).withColumn("alive", F.lit(None).cast("array<long>")))
        return with_any

    alive = _repeated(base, sizes, 0, "_text", None)
    for level in range(1, len(sizes)):
        if alive.isEmpty():
            break
        alive = _repeated(joined(alive, False), sizes, level, "_text", "alive")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, kept = [], [], [], []
            for text, blob in zip(batch.column("_text"), batch.column("alive")):
                words, out = repeated_words(text.as_py(), _longs(blob), window)
                left = b" ".join(w for w, x in zip(words, out.tolist()) if not x) if out.any() else b" ".join(words)
                n.append(len(words)), gone.append(int(out.sum())), digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if texts else "")
            columns = [batch.column("_doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_doc", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = joined(alive, True).mapInArrow(finish, "_doc long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.withColumnRenamed("_doc", id_col) if texts else out.drop("kept_text").withColumnRenamed("_doc", id_col)
