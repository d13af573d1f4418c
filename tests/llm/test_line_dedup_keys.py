"""Line dedup where tokens are common: keys are pairs of neighbouring tokens, with the same lines removed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_operators_llm import removed_lines

from gleanwork.llm import linededup


def near_copies(r, n, words, longest):
    """Lines over few words, half of them copies of earlier ones with some words lost, put in or exchanged."""
    out = []
    for _ in range(n):
        line = list(r.choice(out)) if out and r.random() < 0.5 else r.sample(range(words), r.randrange(1, longest))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(line) + 1)
            line[k : k + r.randrange(2)] = r.sample(range(words), r.randrange(2))
        out.append(line or [0])
    return out


@pytest.mark.parametrize("heavy", [0, 30])
def test_any_share_of_common_tokens(spark, heavy):
    r = random.Random(heavy)
    lines = near_copies(r, 700, 60, 40)
    rows = [(i, "\n".join(" ".join(f"w{x}" for x in line) for line in lines[5 * i : 5 * i + 5])) for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity, num, den in ((0.8, 4, 5), (0.6, 3, 5)):
        found = linededup.removed_lines(docs, similarity=similarity, buckets=1024, heavy=heavy)
        assert {(x["id"], x["line"]) for x in found.collect()} == removed_lines(rows, num, den)


def test_common_tokens_meet_few_lines(spark, monkeypatch):
    """Pairs of lines with a key in common, on lines without near copies: with single tokens as many as the square of the lines asks for."""
    r, kept = random.Random(1), []
    rows = [(i, " ".join(f"w{x}" for x in r.sample(range(1000), 30))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = linededup.cut

    def keep(df, label):
        out = cut(df, label)
        if label == "lines":
            kept.append(out.select(F.explode("prefix").alias("key")).groupBy("key").count().agg(F.sum(F.expr("count * (count - 1)"))).head()[0])
        return out

    monkeypatch.setattr(linededup, "cut", keep)
    assert linededup.removed_lines(docs, buckets=1024).count() == 0  # more words of each than HEAVY would take 20 times the rows
    assert linededup.removed_lines(docs, buckets=1024, heavy=100).count() == 0
    assert kept[1] * 20 < kept[0]


def caught(monkeypatch, label):
    """Tables that are written under this label from now on, each as its rows at once."""
    cut, out = linededup.cut, []

    def keep(df, name):
        made = cut(df, name)
        if name == label:
            out.append(made.collect())
        return made

    monkeypatch.setattr(linededup, "cut", keep)
    return out


def test_words_that_occur_once_are_no_keys(spark, monkeypatch):
    """Near copies that differ in such words only, and lines of nothing else."""
    r, unique = random.Random(2), iter(range(10**6))
    rows = []
    for i in range(200):
        line = [f"w{20 * (i % 40) + k}" for k in range(20)]
        for k in r.sample(range(20), r.randrange(5)):
            line[k] = f"u{next(unique)}"
        rows.append((i, " ".join(line) + "\n" + " ".join(f"u{next(unique)}" for _ in range(30))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = caught(monkeypatch, "lines")
    found = linededup.removed_lines(docs, buckets=1024)
    assert {(x["id"], x["line"]) for x in found.collect()} == removed_lines(rows, 4, 5)
    assert sum(k is not None for x in lines[0] if x["line"] == 1 for k in x["prefix"]) < 100  # of 1,400: the bitset takes a few words for others
    assert any(k is not None for x in lines[0] if x["line"] == 0 for k in x["prefix"])


def test_a_pair_makes_a_row_per_run_of_shared_keys(spark, monkeypatch):
    """Lines that nearly reach the similarity share most of their keys: the join makes few rows of each pair."""
    r = random.Random(3)
    lines = []
    for _ in range(120):
        line = list(range(100))
        for k in r.sample(range(100), 6):
            line[k] = r.randrange(100, 400)
        lines.append(line)
    rows = [(i, " ".join(f"w{x}" for x in line)) for i, line in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kind, made = type(docs), []
    group = kind.groupBy

    def counted(self, *cols):
        if cols == (["x_id", "x_line", "y_id", "y_line"],):
            made.append((self.count(), self.distinct().count()))
        return group(self, *cols)

    monkeypatch.setattr(kind, "groupBy", lambda self, *cols: counted(self, *cols) if cols and isinstance(cols[0], list) else group(self, *cols))
    found = linededup.removed_lines(docs, buckets=1024)
    assert {(x["id"], x["line"]) for x in found.collect()} == removed_lines(rows, 4, 5)
    [(joined, pairs)] = made
    assert pairs and joined < 3 * pairs
