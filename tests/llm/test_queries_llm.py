"""The registered queries against their SQL, and the pipeline stage by stage against brute force."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanwork.llm import queries, similar
from gleanwork.llm.common import cut
from test_operators_llm import frame, held_items, made_up, print_of, removed_lines


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df, expected = queries.QUERIES[name](spark, small), db.sql(queries.ORACLE_SQL[name])
    at = [expected.columns.index(c) for c in sorted(expected.columns)]
    assert sorted(expected.columns) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in expected.fetchall())


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Made-up documents, with a benchmark of which two documents hold an item."""
    path = str(tmp_path_factory.mktemp("sf"))
    rows = made_up(7)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi. rho sigma tau."
    rows += [(500, f"intro words here\n{item}\nand an end"), (501, f"{item} preceded differently by nothing at all but this")]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "never seen words of a benchmark item that nobody copied")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    kept = cut(stages["language_id"](spark, docs, sf_dir))
    assert kept.columns == columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()}
    assert gone == {400, 401, 402, 408}  # nothing with letters is rejected
    before = [(r["doc_id"], r["text"]) for r in kept.collect()]

    lines = cut(stages["line_dedup"](spark, kept, sf_dir))
    out = removed_lines(before)
    expected = []
    for i, t in before:
        left = [x for k, x in enumerate(t.split("\n")) if i is None or (i, k) not in out]
        if len(left) == len(t.split("\n")) or "".join(left).split():
            expected.append((i, "\n".join(left)))
    assert lines.columns == columns
    assert sorted(((r["doc_id"], r["text"]) for r in lines.collect()), key=repr) == sorted(expected, key=repr)
    assert not lines.filter(F.col("n_chars") != F.length("text")).count() and lines.filter("gone <> 'g' OR score <> 's' OR lines <> 'l'").count() == 0

    near = cut(stages["simhash_dedup"](spark, lines, sf_dir))
    prints = [(i, print_of(t, 5)) for i, t in expected]
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {x: min((i for (i, _), y in zip(prints, label) if y == x and i is not None), default=None) for x in label}
    stay = sorted((t for t, x in zip(expected, label) if t[0] is None or t[0] == least[x]), key=repr)
    assert near.columns == columns and sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=repr) == stay

    clean = cut(stages["decontamination"](spark, near, sf_dir))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert clean.columns == columns and {r["doc_id"] for r in near.collect()} - {r["doc_id"] for r in clean.collect()} == {i for i, t in stay if held_items(t, items)} and held_items(item_text(near), items)

    packed = stages["packing"](spark, clean, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    whole = corpus_pipeline.run(spark, sf_dir)
    digest = lambda df: sorted((r["doc_id"] or -1, r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert digest(whole) == digest(packed)


def item_text(docs):
    return docs.filter("doc_id = 500").first()["text"]


def test_stages_on_empty_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_near_dedup_reaches_its_similarity(spark, sf_dir, monkeypatch):
    """Texts of Jaccard 0.8 and more go whatever their fingerprints, by brute force over all pairs; with and without frequent shingles."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(3000)}"
    passage, rows = [word() for _ in range(60)], []
    for g in range(12):
        base = [word() for _ in range(r.randrange(20, 200))] + (passage if g % 2 else [])
        rows.append(base)
        for k in range(8):
            copy, at = list(base), r.randrange(len(base))
            copy[at : at + 1 + k * len(base) // 80] = [word()]
            rows.append(copy)
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    label = list(range(len(rows)))
    far = 0
    for a in range(len(rows)):
        for b in range(a):
            close = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            bits = (print_of(rows[a][1], 5) ^ print_of(rows[b][1], 5)).bit_count()
            far += close and bits > 3
            if (close or bits <= 3) and label[a] != label[b]:
                new, old = sorted((label[a], label[b]))
                label = [new if x == old else x for x in label]
    assert far > 20
    expected = sorted(set(label))
    for least in (similar.FREQUENT, 2):
        monkeypatch.setattr(similar, "FREQUENT", least)
        kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), sf_dir)
        assert sorted(x["doc_id"] for x in kept.collect()) == expected


def test_language_stage_rejects_foreign_texts(spark, sf_dir):
    """Texts of unlearned scripts and of noise go, though their score is about 0.5; all of the generated documents that have letters stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = ["Сегодня утром в городе было тихо, и люди шли на работу.", "今天早上城市很安静，人们慢慢地走。", "Σήμερα το πρωί η πόλη ήταν ήσυχη.", "zqx kvj wpq", "Dzisiaj rano w mieście było cicho, a ludzie powoli szli do pracy."]
    rows = spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(foreign)], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(rows.select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    kept = {r[0] for r in corpus_pipeline.language(spark, both, sf_dir).select("doc_id").collect()}
    assert not [i for i in kept if i < 0]
    lettered = {r[0] for r in docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert lettered <= kept
