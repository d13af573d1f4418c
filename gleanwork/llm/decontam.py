"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Scores are shares of what an item must reach, so that one threshold fits all items. The
index is searched with block-max WAND: blocks are ranges of items, the same for all terms. A passage
is left if the largest impacts of its terms can't reach the threshold together. Else only blocks
count in which a term occurs that can carry an item over the threshold with those of smaller
impact; of these, blocks are left whose own largest impacts can't reach it (for all passages of a text
at once); in the others, cursors over the terms' postings skip to pivots. All items at or above the threshold are retrieved, and the overlap of their question and of their
answer with the passage is verified.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, free_names, others, worker_cache

K1, B = 1.2, 0.75
SHINGLE, OVERLAP = 5, 0.8
BLOCK = 4
SMALL = 0.4
DENSE = 1 << 16  # passages times blocks up to which bounds are added up in a plain array
MAX_CHARS = 4 << 20  # of the items of a part: its index is broadcast, some 60 bytes a character in a worker
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item that has one text: the last sentence is the answer; a single sentence has none."""
    found = re.match(r"(?s)(.*[.?!:\n])\s*(\S.*)$", text.rstrip().rstrip(".?!"))
    return (found[1], found[2]) if found and words_of(found[1]) and words_of(found[2]) else (text, "")


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def bearable(own: list[set[tuple[str, ...]]], whole: set[tuple[str, ...]] | None, overlap: float) -> int:
    """How many of an item's words a text may lack that still has the overlap of its shingles: no more than shingles that may be missing.

    Every word that is missing takes another shingle with it: the one that it begins, or ends, where it comes first.
    """
    missing = lambda s: len(s) - math.ceil(overlap * len(s) - 1e-9)
    return max(sum(map(missing, own)), missing(whole) if whole else 0)


class Index:
    """BM25 impacts of items, as shares of what each item must reach.

    items: (id, question, answer), ids ascending; split: whether question and answer are one text's, see hits().
    An item's score is at most that for its own text. What a text must reach of it (`limits`) is the threshold, if
    one is given; else all but the largest impacts of as many words as a text that has the overlap can lack, so
    that no such text is missed. Impacts are divided by this, so the search's threshold is 1 for all items.
    """

    def __init__(self, items: list[tuple[int, str, str]], block: int = BLOCK, split: bool = False, threshold: float | None = None, overlap: float = OVERLAP) -> None:
        items = [x for x in items if words_of(x[1]) or words_of(x[2])]
        self.ids = [x[0] for x in items]
        self.overlap = overlap
        self.parts = [[shingles(words_of(q)), shingles(words_of(a))] for _, q, a in items]
        self.whole = [shingles(words_of(q) + words_of(a)) if split else None for _, q, a in items]
        bags = [Counter(words_of(q) + words_of(a)) for _, q, a in items]
        self.longest = max((sum(b.values()) for b in bags), default=1)
        mean = sum(sum(b.values()) for b in bags) / max(1, len(bags))
        df = Counter(w for b in bags for w in b)
        self.terms = {w: i for i, w in enumerate(sorted(df))}
        idf = {w: np.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        self.limits = np.ones(len(items))
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for i, b in enumerate(bags):
            own = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * sum(b.values()) / mean)) for w, f in b.items()}
            total = sum(own.values())
            lacks = sum(sorted(own.values(), reverse=True)[: bearable(self.parts[i], self.whole[i], overlap)])
            self.limits[i] = (total - lacks) / total if threshold is None else threshold
            for w, v in own.items():
                postings[self.terms[w]].append((i, v / total / self.limits[i]))
        self.postings = [([i for i, _ in p], [v for _, v in p]) for p in postings]
        self.best = np.array([max(v) for _, v in self.postings]) if postings else np.zeros(0)
        self.block = block
        # By term, the blocks that it occurs in and its largest impact there: one array of each, and where a term's begin.
        found = []
        for at, v in self.postings:
            b = np.array(at) // block
            edge = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            found.append((b[edge], np.maximum.reduceat(np.array(v), edge)))
        self.blocks = -(-len(items) // block)
        self.sizes = np.array([len(b) for b, _ in found], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.in_block = np.concatenate([b for b, _ in found]) if found else np.zeros(0, np.int64)
        self.most = np.concatenate([m for _, m in found]) if found else np.zeros(0)
        self.places = np.repeat(np.arange(len(found)), self.sizes) * self.blocks + self.in_block  # ascending

    def pivots(self, passage: np.ndarray, term: np.ndarray, threshold: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) for all blocks whose bound reaches the threshold, given the different terms of passages, in order of passages.

        In each passage, terms of small largest impacts that don't reach SMALL of the threshold together can't carry
        an item: only blocks that the others occur in are looked at, first with those others' block maxima and the
        rest's largest impacts at all, then with all block maxima. No step looks at every block.
        """
        best = self.best[term]
        order = np.lexsort((best, passage))
        passage, term, best = passage[order], term[order], best[order]
        new = np.append(True, passage[1:] != passage[:-1]) if len(passage) else np.zeros(0, bool)
        total = np.cumsum(best)
        before = (total - best)[new][np.cumsum(new) - 1]
        can = np.bincount(passage, best) >= threshold - 1e-9
        carries = (total - before >= SMALL * threshold) & can[passage]
        if not carries.any():
            return passage[:0], passage[:0]
        slack = np.bincount(passage[~carries], best[~carries], int(passage.max()) + 1)
        p, t = passage[carries], term[carries]
        size = self.sizes[t]
        at = np.repeat(self.starts[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        keys = np.repeat(p, size) * self.blocks + self.in_block[at]
        if (int(p.max()) + 1) * self.blocks <= DENSE:
            bound = np.bincount(keys, self.most[at])
            keys = np.flatnonzero(bound)
            bound = bound[keys]
        else:
            keys, back = np.unique(keys, return_inverse=True)
            bound = np.bincount(back, self.most[at], len(keys))
        good = bound + slack[keys // self.blocks] >= threshold - 1e-9
        keys, bound = keys[good], bound[good]
        # What the small terms add, of those passages that are left.
        rest_p, rest_t = passage[~carries], term[~carries]
        first, last = np.searchsorted(rest_p, keys // self.blocks), np.searchsorted(rest_p, keys // self.blocks, "right")
        n = last - first
        which = np.repeat(np.arange(len(keys)), n)
        t = rest_t[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        wanted = t * self.blocks + (keys % self.blocks)[which]
        place = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
        bound += np.bincount(which, np.where(self.places[place] == wanted, self.most[place], 0.0), len(keys))
        keys = keys[bound >= threshold - 1e-9]
        return keys // self.blocks, keys % self.blocks

    def search(self, terms: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
        """All (item's number, score) with a score of at least the threshold, for a passage's different terms."""
        _, blocks = self.pivots(np.zeros(len(terms), np.int64), np.array(terms, np.int64), threshold)
        return [x for b in blocks.tolist() for x in self._wand(terms, b * self.block, (b + 1) * self.block, threshold)]

    def _wand(self, terms: list[int], low: int, high: int, threshold: float) -> list[tuple[int, float]]:
        """WAND within one block, whose largest impacts bound the terms."""
        cursors = []  # [current item, position, its end, items, impacts, largest impact in the block]
        for t in terms:
            items, values = self.postings[t]
            i = bisect_left(items, low)
            j = bisect_left(items, high, i)
            if i < j:
                cursors.append([items[i], i, j, items, values, max(values[i:j])])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[5]
                if bound >= threshold - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            # Cursors before the pivot skip to it; if all stand on it, it is scored and they go past it.
            score = sum(c[4][c[1]] for c in cursors if c[0] == pivot) if cursors[0][0] == pivot else None
            if score is not None and score >= threshold - 1e-9:
                out.append((pivot, score))
            for c in cursors:
                if c[0] <= pivot:
                    c[1] = bisect_left(c[3], pivot + (score is not None), c[1], c[2])
                    c[0] = c[3][c[1]] if c[1] < c[2] else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def hits(self, text: str | None) -> dict[int, float]:
        """Items (by id) that the text holds, with the best score of its passages, as a share of the item's own.

        Passages are windows of twice the longest item's words, each half overlapping the next, so
        that any span as long as an item lies within one. Both parts of an item must be covered; of
        items split from one text, the longer part and the whole text suffice, so that a missing or
        changed word in a short last sentence doesn't hide a copy.
        """
        if not self.ids:
            return {}
        words = words_of(text)
        known = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(known >= 0)
        if not len(at):
            return {}
        step, v = self.longest, len(self.terms)
        # A word belongs to the passage that starts with its step, and to the one before.
        first = at // step
        keys = np.unique(np.concatenate([first * v + known[at], np.maximum(first - 1, 0) * v + known[at]]))
        passage, term = keys // v, keys % v
        out: dict[int, float] = {}
        before, cache, own = -1, {}, []
        for p, b in zip(*(x.tolist() for x in self.pivots(passage, term))):
            i, j = np.searchsorted(passage, (p, p + 1)).tolist()
            for k, score in self._wand(term[i:j].tolist(), b * self.block, (b + 1) * self.block, 1.0):
                if p != before:
                    # The sets of the passage's shingles, by length: shorter parts have one of their own length.
                    before, cache, own = p, {}, words[p * step : (p + 2) * step]
                if self._held(k, own, cache, self.overlap):
                    out[self.ids[k]] = max(score * self.limits[k], out.get(self.ids[k], 0.0))
        return out

    def _held(self, k: int, words: list[str], cache: dict[int, set], overlap: float) -> bool:
        found = [self._overlap(part, words, cache) >= overlap for part in self.parts[k] if part]
        if all(found) or self.whole[k] is None:
            return all(found)
        longer = max(self.parts[k], key=len)
        return all(self._overlap(part, words, cache) >= overlap for part in (longer, self.whole[k]))

    @staticmethod
    def _overlap(part: set[tuple[str, ...]], words: list[str], cache: dict[int, set]) -> float:
        n = len(next(iter(part)))
        if n not in cache:
            cache[n] = shingles(words, n)
        return len(part & cache[n]) / len(part)


def indices_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None, threshold: float | None = None, overlap: float = OVERLAP, max_chars: int = MAX_CHARS) -> Iterator[Index]:
    """Indices of a benchmark's parts, of about max_chars characters each (one item may have more); one part is held at a time.

    Without an answer column, an item's last sentence is its answer. Items without words or with a
    null id are left out; of items with the same id, each is indexed.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    answer = F.coalesce(col(answer_col), F.lit("")) if answer_col else F.lit("")
    rows = items.filter(col(id_col).isNotNull()).select(col(id_col).cast("long").alias("i"), text.alias("q"), answer.alias("a"))
    # Items of like length are in one part, as the longest item of a part sets the length of its passages.
    rows = rows.withColumn("size", F.floor(F.log2(F.length("q") + F.length("a") + 64.0) / 3))
    for size, chars in sorted(map(tuple, rows.groupBy("size").agg(F.sum(F.length("q") + F.length("a") + 16)).collect())):
        parts_ = -(-chars // max_chars)
        for k in range(parts_):
            some = rows.filter((F.col("size") == size) & (F.pmod(F.xxhash64("i", "q", "a"), F.lit(parts_)) == k)).collect()
            yield Index(sorted((r["i"], *(parts(r["q"]) if answer_col is None else (r["q"], r["a"]))) for r in some), split=answer_col is None, threshold=threshold, overlap=overlap)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float | None = None, overlap: float = OVERLAP, names: tuple[str, str, str] = ("contaminated", "items", "best_score"), max_chars: int = MAX_CHARS, **item_columns: str) -> DataFrame:
    """docs with three more columns, by default contaminated, items (sorted array of item ids), best_score (0 without items).

    A document is contaminated by an item if one of its passages reaches the item's threshold and
    holds at least `overlap` of the item's different five-word shingles, in its question and in its
    answer each (a part with fewer words is one shingle); without an answer column, in the whole text
    and the longer of both parts is enough. Words are runs of letters, digits and underscores, in
    lower case. threshold: a share of the items' own scores; by default each item's is as low as the
    overlap asks for, so that retrieval misses nothing (see Index). There is no shuffle. Benchmarks of
    over max_chars characters, or with items of very different lengths, are taken in parts, one pass each.

    Nulls: a null or empty text holds nothing, nor does any text if there are no items. Repeated rows
    give repeated results; an empty table of docs gives no rows. Columns of
    docs with the new ones' names, in any letter case, are replaced.
    """
    kept = others(docs, *names)
    found, more = free_names(docs, "found", "more")
    rows, before = docs.select(*map(col, kept)), None
    nothing = F.struct(F.array().cast("array<long>").alias("items"), F.lit(0.0).alias("best_score"))

    def judged(index: Index) -> Callable[[Column], Column]:
        held = docs.sparkSession.sparkContext.broadcast(index)

        @F.arrow_udf("items array<long>, best_score double")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            worker_cache("decontam")
            for batch in batches:
                hits = [held.value.hits(t.as_py()) for t in batch]
                items_, scores = pa.array([sorted(x) for x in hits], pa.list_(pa.int64())), pa.array([max(x.values(), default=0.0) for x in hits], pa.float64())
                yield pa.StructArray.from_arrays([items_, scores], names=["items", "best_score"])

        return run

    for index in indices_of(items, threshold=threshold, overlap=overlap, max_chars=max_chars, **item_columns):
        if not index.ids:
            continue
        one = judged(index)(col(text_col))
        if before is None:
            rows = rows.withColumn(found, one)
        else:  # a table between parts: a worker then holds one index at a time
            rows = cut(rows, "part").withColumn(more, one)
            both = F.struct(F.array_sort(F.array_union(F.col(found)["items"], F.col(more)["items"])).alias("items"), F.greatest(F.col(found)["best_score"], F.col(more)["best_score"]).alias("best_score"))
            rows = rows.withColumn(found, both).drop(more)
        before = index
    if before is None:
        rows = rows.withColumn(found, nothing)
    new = F.size(F.col(found)["items"]) > 0, F.col(found)["items"], F.col(found)["best_score"]
    return rows.select(*map(col, kept), *[c.alias(name) for c, name in zip(new, names)])
