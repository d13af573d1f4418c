"""A training corpus from raw documents, stage by stage.

Every stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and is the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork import bitset
from gleanwork.llm import decontam, langid, linededup, packing, simhash
from gleanwork.llm.common import SPACES, col, cut, drop_cut, free_names, table
from gleanwork.llm.queries import tokenizer_path

#: A text's regression value for its language, from -1 to 1 mapped to 0 to 1, that rejects it.
LEAST_LANGUAGE_SCORE = 0.4
#: The share of a text's 3-grams of letters that learned texts have, below which it is like none of them.
LEAST_KNOWN = 0.6
#: Jaccard similarity of five-word shingles from which documents are near duplicates.
NEAR_SIMILARITY = 0.8
#: Texts that a Python worker takes at a time.
BATCH = 1000
#: Words that a worker of the packing stage remembers, fewer than the operator's own: executors still hold what earlier stages took.
CACHE = 100_000


def bounded(spark: SparkSession) -> None:
    """Workers take so many texts at a time: what a batch holds counts twice, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def columns(docs: DataFrame) -> list[Column]:
    return [col(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: no text, no letter, or like none of the learned languages.

    Learns from the documents that have a language; if none has, only texts without letters go.
    """
    bounded(spark)
    lang, score, known = free_names(docs, "lang_pred", "score", "known")
    found = langid.identify(docs, model := langid.train(docs), names=(lang, score), known=known)
    keep = (F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE) & (F.col(known) >= LEAST_KNOWN) if model.languages else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.filter(keep).select(columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are similar to earlier ones. Documents that lose all their words this way go; n_chars is the new length."""
    n_lines, n_removed = free_names(docs, "n_lines", "n_removed")
    found = linededup.dedup_lines(docs, names=(n_lines, n_removed))
    emptied = (F.col(n_removed) > 0) & (F.translate("text", SPACES, "") == "")
    found = found.filter(~F.coalesce(emptied, F.lit(False)))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", F.when(F.col(n_removed) > 0, length).otherwise(F.col("n_chars"))).select(columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Links are a Jaccard similarity of five-word shingles of at least NEAR_SIMILARITY, or fingerprints of them within three bits. Rows with a null id stay.
    """
    bounded(spark)
    found = simhash.simhash_dedup(docs, shingle=5, similarity=NEAR_SIMILARITY)
    gone = cut(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    bits = bitset.fitting(gone, linededup.FILTER_BITS)
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    chosen = bitset.build(gone, at, bits)
    # Only documents that may be among those that go take part in the join.
    maybe = F.coalesce(bitset.has(chosen, at), F.lit(False))
    return docs.filter(~maybe).unionByName(docs.filter(maybe).join(gone, "doc_id", "left_anti").select(columns(docs)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bounded(spark)
    names = tuple(free_names(docs, "contaminated", "items", "best_score"))
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), names=names)
    return found.filter(~F.col(names[0])).select(columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left: the rows of op4."""
    bounded(spark)
    return packing.pack(docs, tokenizer_path(), cache=CACHE)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: Language models and tokenizers can't be expressed in SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
