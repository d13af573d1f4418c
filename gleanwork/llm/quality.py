"""Quality classification by a regularised quadratic discriminant over document statistics.

Each class is a normal distribution of transformed statistics. Its covariance is shrunk towards the
pooled one, and that towards a multiple of the identity; a score is the logistic of the difference
of log-densities (Mahalanobis distances by cached Cholesky factors, log-determinants, log-priors).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

POOLED, IDENTITY = 0.2, 0.02  # shrinkage towards the pooled covariance, and towards the identity
NAMES = (
    "chars", "words", "word_length", "word_spread", "letters", "upper", "digits", "marks", "space", "distinct_words", "top_word",
    "next_same", "distinct_lines", "line_words", "stops", "commas", "bars", "bangs", "short_words", "lower_lines", "capital_words", "entropy",
)


def _kinds() -> np.ndarray:
    """A class per code point below 0x3000: 0 other, 1 lower or caseless letter, 2 upper-case letter, 3 digit, 4 white space."""
    out = np.zeros(0x3000, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        out[i] = 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 0
    return out


KINDS = _kinds()


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one text, in the order of NAMES: counts as logarithms, shares as arcsines of their roots."""
    text = text or ""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    n = max(1, len(c))
    kind = np.bincount(KINDS[np.minimum(c, 0x2FFF)], minlength=5)
    letters = max(1, kind[1] + kind[2])
    words = text.split()
    w = max(1, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    low = np.bincount(np.minimum(c, 255), minlength=256)[1:255]
    p = low[low > 0] / max(1, low.sum())
    share = lambda x: np.arcsin(np.sqrt(min(1.0, max(0.0, x))))
    return np.array([
        np.log1p(len(c)), np.log1p(len(words)), np.log1p(size.mean()), np.log1p(size.std()), share((kind[1] + kind[2]) / n), share(kind[2] / letters), share(kind[3] / n),
        share(kind[0] / n), share(kind[4] / n), share(len(counts) / w), share(max(counts.values(), default=0) / w), share(same / w), share(len(set(lines)) / k), np.log1p(w / k),
        share(text.count(".") / w), share(text.count(",") / w), share(text.count("|") / w), share((text.count("!") + text.count("?")) / w), share(float((size <= 3).mean())),
        share(sum(x[0].islower() for x in lines) / k), share(sum(x[0].isupper() for x in words) / w), -float((p * np.log(p)).sum()) if len(p) else 0.0,
    ])


@dataclass
class Model:
    """Per class (0, 1): log-prior less half the log-determinant, mean, inverse Cholesky factor. Without both classes: the prior alone."""

    constants: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    prior: float
    both: bool

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1 for rows of statistics."""
        if not self.both or not len(x):
            return np.full(len(x), self.prior)
        log = [self.constants[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -700, 700)))


def model_of(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float = POOLED, identity: float = IDENTITY) -> Model:
    """From the classes' counts (2), sums (2, d) and sums of outer products (2, d, d)."""
    prior = (n[1] + 1) / (n.sum() + 2)
    d = sums.shape[1]
    if min(n) < 2:
        return Model(np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d)), float(prior), False)
    means = sums / n[:, None]
    scatter = squares - n[:, None, None] * np.einsum("ki,kj->kij", means, means)
    whole = scatter.sum(axis=0) / n.sum()
    constants, factors = np.zeros(2), np.zeros((2, d, d))
    for k in (0, 1):
        own = (1 - pooled) * scatter[k] / n[k] + pooled * whole
        # The identity is scaled by statistic, so that the scale of one does not matter to another.
        own = (1 - identity) * own + identity * np.diag(np.maximum(np.diag(own), 1e-6)) + 1e-9 * np.eye(d)
        chol = np.linalg.cholesky(own)
        factors[k] = np.linalg.inv(chol)
        constants[k] = np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(chol)).sum()
    return Model(constants, means, factors, float(prior), True)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, x): the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], [id_col, "x"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` long, x array<double>")


def train(rows: DataFrame, labels: DataFrame, learns: Column | None = None, id_col: str = "doc_id", label_col: str = "quality", pooled: float = POOLED, identity: float = IDENTITY) -> Model:
    """Fits on all labelled rows (of measured()) that may be learned from; only sums leave the executors.

    Labels other than 0 and 1 are ignored. A label that occurs more than once counts as often.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_label IN (0, 1)")
    rows = rows.filter(F.lit(True) if learns is None else learns)
    found = rows.join(known, F.col(id_col) == F.col("_id")).select("_label", "x")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(2), {}
        for pdf in batches:
            for k, own in pdf.groupby("_label"):
                x = np.stack(own["x"].to_numpy())
                n[k] += len(x)
                s[k] = s.get(k, 0) + np.concatenate([x.sum(axis=0), (x.T @ x).ravel()])
        for k, v in s.items():
            yield pd.DataFrame({"label": k, "at": range(-1, len(v)), "value": [n[k], *v]})

    sums = found.mapInPandas(moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    d = len(NAMES)
    flat = np.zeros((2, 1 + d + d * d))
    for r in sums:
        flat[r["label"], r["at"] + 1] = r["value"]
    return model_of(flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d), pooled, identity)


def classify(docs: DataFrame, labels: DataFrame, learns: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1, higher: better), predicted (1 if score >= threshold).

    Texts are read once and whole; only their statistics, written to the shared folder, are joined
    with labels (on ids, which a bounded number of labels shares) and scored.

    Nulls: a null text counts as empty, and empty texts have a score like any other. A null id is
    never learned from. Labels of unknown documents are ignored; without two labels of either class
    every score is the smoothed share of good labels. Repeated rows give repeated results. An empty
    table gives no rows; other columns of docs and labels are ignored.
    """
    rows = cut(measured(docs, id_col, text_col), "statistics")
    held = docs.sparkSession.sparkContext.broadcast(train(rows, labels, learns, id_col, label_col))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    out = rows.select(id_col, score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
