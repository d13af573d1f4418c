"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: how many different character
n-grams, n = 1 to 3, they share, over the geometric mean of how many each has. Nyström landmarks Z
(training texts of all languages) give the features k(x, Z) K(Z, Z)^(-1/2); kernel ridge regression
on them, one language against the rest, gives weights A, so that the scores of texts X are the
matrix product K(X, Z) A. K(X, Z) itself is P(X) P(Z)^T, P being the 0/1 matrix of n-grams that
occur in landmarks, so texts are scored together as the sparse product P(X) (P(Z)^T A), over the
square roots of how many n-grams they have.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, free_names, others, worker_cache

#: What is learned from: so many languages at most, those with the most labelled texts, and so many texts of each, by the hash of text and id.
LANGUAGES, PER_LANGUAGE = 256, 300
LANDMARKS = 60  # of the texts of a language, landmarks at most
RIDGE = 0.1
UNDETERMINED = "und"
#: n-grams that are looked at in one piece of a long text, entries of P(X) in one product, and symbols for which n-grams have a table.
PIECE, TOGETHER, SYMBOLS = 1 << 20, 1 << 18, 160
POINTS = 0x110000


def points(text: str) -> np.ndarray:
    """The text's code points, plus 1: white space as one blank, lower case."""
    return np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64) + 1


def codes(text: str) -> np.ndarray:
    """The text's different n-grams, as sorted numbers: code points of 21 bits each."""
    c, found = points(text), []
    for at in range(0, len(c), PIECE):
        c3 = c[at : at + PIECE + 2]
        one, two = c3[:PIECE], c3[: PIECE + 1][:-1] << 21 | c3[1 : PIECE + 1]
        found.append(np.unique(np.concatenate([one, two, c3[:-2] << 42 | c3[1:-1] << 21 | c3[2:]])))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


BLANK = ord(" ") + 1


def _kinds(c: np.ndarray) -> np.ndarray:
    """Of code points (plus 1): 1 for letters and their marks, 2 for digits, 0 for all else."""
    return np.fromiter((2 if chr(x - 1).isnumeric() else 1 if unicodedata.category(chr(x - 1))[0] in "LM" else 0 for x in c.tolist()), np.int8, len(c))


def _in_words(kind: np.ndarray) -> np.ndarray:
    """Which 3-grams count as parts of words: without digits, and without two neighbours that are neither letters."""
    two = (kind[:-1] != 2) & (kind[1:] != 2) & (kind[:-1] + kind[1:] > 0)
    return two[:-1] & two[1:]


@dataclass
class Model:
    """grams: sorted n-grams of the landmarks; weights: a row per n-gram, a column per language."""

    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray
    _tables: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": {}}

    def _table(self) -> dict:
        """Symbols are the code points of landmarks, numbered from 1. n-grams of symbols are numbered by a table, if they aren't too many."""
        if not self._tables and len(self.grams):
            symbols = self.grams[self.grams < 1 << 21]
            n = len(symbols) + 1
            number = np.zeros(POINTS + 1, np.int32)
            number[symbols] = np.arange(1, n)
            t = self._tables
            t.update(n=n, number=number, kind=np.append(np.int8(0), _kinds(symbols)), row=None)
            if n <= SYMBOLS:
                parts = [number[self.grams >> shift & (1 << 21) - 1].astype(np.int64) for shift in (42, 21, 0)]
                t["row"] = np.full(n**3, -1, np.int32)
                t["row"][(parts[0] * n + parts[1]) * n + parts[2]] = np.arange(len(self.grams))
                t["last"] = np.zeros(n**3, np.int32)
        return self._tables

    def rows_of(self, text: str) -> tuple[np.ndarray, int, float]:
        """Of one text: which landmarks' n-grams it has, how many different n-grams it has at all, and known()."""
        if not len(self.grams):
            return np.zeros(0, np.int64), 1, 0.0
        t, c = self._table(), points(text)
        if len(c) <= PIECE and t["row"] is not None and (s := t["number"][c].astype(np.int64)).all():
            n = t["n"]
            two = s[:-1] * n + s[1:]
            three = two[:-1] * n + s[2:]
            all_ = np.concatenate([s, two, three])
            # An n-gram's last place among all marks it once.
            place = np.arange(len(all_), dtype=np.int32)
            t["last"][all_] = place
            own = all_[t["last"][all_] == place]
            at = t["row"][own]
            kind = t["kind"][s]
            if (in_words := _in_words(kind)).any():
                plain = np.where(kind == 1, s, t["number"][BLANK])
                three = ((plain[:-2] * n + plain[1:-1]) * n + plain[2:])[in_words]
            return at[at >= 0], len(own), float((t["row"][three] >= 0).mean()) if len(three) else 0.0
        own = codes(text)
        at = self._find(own)
        tally = np.zeros((2, 2))  # hits and 3-grams: of all, and in words
        for i in range(0, len(c) - 2, PIECE):
            part = c[i : i + PIECE + 2]
            some, back = np.unique(part, return_inverse=True)
            kind = _kinds(some)[back]
            for which, (p, those) in enumerate(((part, slice(None)), (np.where(kind == 1, part, BLANK), _in_words(kind)))):
                three = (p[:-2] << 42 | p[1:-1] << 21 | p[2:])[those]
                tally[which] += (self._find(three) >= 0).sum(), len(three)
        hits, counted = tally[1] if tally[1][1] else tally[0]
        return at[at >= 0], len(own), hits / counted if counted else 0.0

    def _find(self, own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        return np.where(self.grams[at] == own, at, -1)

    def judge(self, texts: Iterator[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(scores, a row per text; known()) of the texts, as many at a time as have TOGETHER entries in P."""
        held, size = [], 0
        for text in texts:
            held.append(self.rows_of(text))
            size += len(held[-1][0])
            if size >= TOGETHER:
                yield self._product(held)
                held, size = [], 0
        if held:
            yield self._product(held)

    def _product(self, held: list[tuple[np.ndarray, int, float]]) -> tuple[np.ndarray, np.ndarray]:
        """The sparse matrix P(X), by rows, times the weights."""
        sizes = np.array([len(at) for at, _, _ in held])
        out = np.zeros((len(held), len(self.languages)))
        if sizes.any():
            gathered = self.weights[np.concatenate([at for at, _, _ in held])]
            out[sizes > 0] = np.add.reduceat(gathered, (np.cumsum(sizes) - sizes)[sizes > 0], axis=0)
        return out / np.sqrt(np.array([n for _, n, _ in held]))[:, None], np.array([k for _, _, k in held])

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([s for s, _ in self.judge(iter(texts))] or [np.zeros((0, len(self.languages)))])

    def known(self, text: str | None) -> float:
        """The share of the text's 3-grams in words, repeats included, that landmarks have, marks counting as blanks; of all its 3-grams if none is in a word. See _in_words()."""
        return self.rows_of(text)[2] if text else 0.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The languages, scores from 0 to 1 (the regression's value for the language, against -1 and 1), and known()."""
        found, scores, known = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        at = 0
        for f, share in self.judge(texts[i] for i in rows):
            best = f.argmax(axis=1)
            value = np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1)
            for i, b, v, k in zip(rows[at : at + len(f)], best, value, share):
                found[i], scores[i], known[i] = self.languages[b], v, k
            at += len(f)
        return found, scores, known


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learns from labelled texts; landmarks: how many per language."""
    return fit_sets([codes(t) for t in texts], languages, landmarks, ridge)


def fit_sets(sets: list[np.ndarray], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The same from the texts' codes()."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0)))
    chosen = [i for name in names for i in [j for j, x in enumerate(languages) if x == name][:landmarks]]
    grams = np.unique(np.concatenate([sets[i] for i in chosen]))

    def presence(some: list[int]) -> np.ndarray:
        p = np.zeros((len(some), len(grams)), np.float32)
        for row, i in enumerate(some):
            p[row, np.isin(grams, sets[i], assume_unique=True)] = 1 / np.sqrt(len(sets[i]))
        return p

    z = presence(chosen)
    kzz = (z @ z.T).astype(np.float64)
    value, vector = np.linalg.eigh(kzz)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # K(Z, Z)^(-1/2), without what is numerically zero
    gram, target = np.zeros((good.sum(),) * 2), np.zeros((int(good.sum()), len(names)))
    for at in range(0, len(sets), 256):
        some = [*range(at, min(at + 256, len(sets)))]
        phi = (presence(some) @ z.T).astype(np.float64) @ root
        y = np.where(np.array([languages[i] for i in some])[:, None] == np.array(names), 1.0, -1.0)
        gram += phi.T @ phi
        target += phi.T @ y
    a = root @ np.linalg.solve(gram + ridge * np.eye(len(gram)), target)
    return Model(names, grams, z.T.astype(np.float64) @ a)


def train(docs: DataFrame, learns: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Fits a model on at most per_language documents of each of at most so many languages, those with the smallest hashes of id and text.

    learns: which rows may be learned from. Rows with a null language, or a null or letterless text,
    are never learned from; with none left, the model has no language and predicts `und` only. Beyond
    `languages`, those with the most rows are learned (ties by name).

    Rows are counted by language first, so that each task hands on only rows whose hash is small
    enough to be among the first, about twice as many as are wanted in all. What reaches the driver is
    the different n-grams of the chosen texts, whole texts being read on the executors.
    """
    rows = docs.filter(col(lang_col).isNotNull() & col(text_col).rlike(r"\p{L}") & (F.lit(True) if learns is None else learns))
    rows = rows.select(col(lang_col).cast("string").alias("lang"), F.xxhash64(col(id_col), F.xxhash64(col(text_col))).alias("rank"), col(text_col).alias("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = F.least(F.lit(1.0), (2.0 * per_language + 50) / F.col("n"))
    some = rows.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang")
    some = some.filter(F.pmod(F.col("rank"), F.lit(1 << 40)) < F.col("share") * (1 << 40))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.col("rank"), F.lit(1 << 40)), "rank", F.xxhash64("text"))
    chosen = some.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)

    @F.arrow_udf("array<long>")
    def grams(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([codes(t.as_py()) for t in batch], pa.list_(pa.int64()))

    found = sorted(((r["lang"], r["place"], np.array(r["grams"], np.int64)) for r in chosen.select("lang", "place", grams("text").alias("grams")).toLocalIterator()), key=lambda x: x[:2])
    return fit_sets([x[2] for x in found], [x[0] for x in found])


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score"), known: str | None = None) -> DataFrame:
    """docs with two more columns, by default lang_pred and score (columns of docs with these names, in any letter case, are replaced).

    known: a third column's name, for the share of the text's 3-grams in words that landmarks have, see Model.known():
    a text unlike all learned languages has a score of about 0.5, but a small share.

    Nulls: a null text, or one without letters, is `und` with score 0; so is every text if nothing
    was learned. Only the text is looked at, and whole. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    new = [*names, *([known] if known else [])]
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("known", pa.float64())])

    @F.arrow_udf("lang_pred string, score double, known double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_cache("langid")
        for batch in batches:
            parts = []
            for at in range(0, len(batch), 256):
                found, scores, share = held.value.predict(batch[at : at + 256].to_pylist())
                parts.append(pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores), pa.array(share)], fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    (found,) = free_names(docs, "found")
    rows = docs.select(*map(col, others(docs, *new)), run(col(text_col)).alias(found))
    return rows.select(*map(col, others(docs, *new)), *[F.col(found)[c].alias(name) for c, name in zip(("lang_pred", "score", "known"), new)])
