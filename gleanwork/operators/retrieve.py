"""Similarity search, reranking, and assembly of contexts and prompts, for many queries in one job."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Options
from ..functions import text as T
from ..functions import vector as V
from ..storage import cut

#: Bytes of query vectors that one pass over the vectors takes: what is sent to each task at once.
BLOCK_BYTES = 32 << 20
#: Queries and vectors that one product compares: so many similarities of 8 bytes are held.
QUERIES, SLICE = 512, 4096


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """vectors' k nearest to one query vector, with `sim` and `rank` (from 1; equal ones by id).

    Tasks keep k rows each, and only those are brought together.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.withColumn("sim", V.cosine(F.col(vector_col), q)).orderBy(F.desc("sim"), F.asc(id_col)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), F.asc(id_col))))


def _rows(batch: pa.RecordBatch, id_col: str, vector_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a batch's rows that have both, of this width and without nulls."""
    own, lists = batch.column(id_col), batch.column(vector_col)
    sizes = np.diff(lists.offsets.to_numpy())
    good = ~np.asarray(own.is_null()) & ~np.asarray(lists.is_null())
    flat = lists.values.slice(lists.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False).astype(np.float64)
    good &= sizes == width
    starts = np.cumsum(sizes) - sizes
    x = flat[starts[good][:, None] + np.arange(width)]
    fine = ~np.isnan(x).any(axis=1)
    x, ids = x[fine], own.filter(pa.array(good)).to_numpy(zero_copy_only=False)[fine].astype(np.int64)
    size = np.sqrt((x * x).sum(axis=1))
    return ids, x / np.where(size == 0, 1, size)[:, None]


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the k largest similarities with their ids, in no order; of equal ones the smallest ids."""
    if sims.shape[1] <= k:
        return sims, ids
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(sims, at, 1).min(axis=1)
    for row in np.flatnonzero((sims >= edge[:, None]).sum(axis=1) > k):
        some = np.flatnonzero(sims[row] >= edge[row])
        at[row] = some[np.lexsort((ids[row, some], -sims[row, some]))[:k]]
    return np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)


def _nearest(block, k: int, id_col: str, vector_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: each task's k nearest vectors to every query of a broadcast block (ids, unit vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, vectors = block.value
        parts = range(0, len(queries), QUERIES)
        best = [(np.zeros((len(queries[p : p + QUERIES]), 0)), np.zeros((len(queries[p : p + QUERIES]), 0), np.int64)) for p in parts]
        for batch in batches:
            ids, x = _rows(batch, id_col, vector_col, vectors.shape[1])
            for i in range(0, len(ids), SLICE):
                own, some = ids[i : i + SLICE], x[i : i + SLICE].T
                for j, p in enumerate(parts):
                    sims, found = _top(vectors[p : p + QUERIES] @ some, np.broadcast_to(own, (len(best[j][0]), len(own))), k)
                    best[j] = _top(np.hstack([best[j][0], sims]), np.hstack([best[j][1], found]), k)
        for p, (sims, found) in zip(parts, best):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries[p : p + QUERIES], sims.shape[1])), pa.array(found.ravel()), pa.array(sims.ravel())], ["query_id", id_col, "sim"])

    return run


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id_col, sim, rank): the k nearest vectors (with integer ids) of every query, exactly.

    Queries are taken in blocks of at most block_bytes of vectors, of which the driver holds one at a
    time; each passes over the vectors once, and of every task's rows only k per query are shuffled. A
    task holds a block, its k nearest, and one product of fixed size. Vectors that are null, hold nulls
    or are of another width than the block's queries are skipped; queries of other widths form blocks of their own.
    """
    spark = vectors.sparkSession
    rows = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    rows = cut(rows.filter("q IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)").withColumn("width", F.size("v")), "queries")
    vectors = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias(vector_col))
    kind, parts = f"query_id long, `{id_col}` long, sim double", []
    for width, n in sorted(map(tuple, rows.groupBy("width").agg(F.count(F.lit(1))).collect())):
        blocks = -(-n * width * 8 // block_bytes)
        for b in range(blocks):
            mine = rows.filter((F.col("width") == width) & (F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).select("q", "v").toArrow()
            ids, unit = _rows(mine.combine_chunks().to_batches()[0], "q", "v", width) if mine.num_rows else (np.zeros(0, np.int64), np.zeros((0, width)))
            held = spark.sparkContext.broadcast((ids, unit))
            found = vectors.mapInArrow(_nearest(held, k, id_col, vector_col), kind)
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc(id_col)))
            parts.append(cut(found.withColumn("rank", rank).filter(F.col("rank") <= k), "nearest"))
            held.destroy()
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], f"{kind}, rank int")


class Reranker(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        """A score from 0 to 1 per pair of query and text."""


def overlap_reranker(pairs: list[tuple[str, str]]) -> list[float]:
    """Offline default: the logistic of how many of the query's character trigrams the text has."""

    def grams(t: str) -> set[str]:
        low = " ".join(t.lower().split())
        return {low[i : i + 3] for i in range(max(1, len(low) - 2))}

    return [1 / (1 + math.exp(4 - 8 * len(q & grams(t)) / max(1, len(q)))) for q, t in ((grams(q), t) for q, t in pairs)]


def rerank_scores(query: Column, text: Column, make: Callable[[], Reranker] = lambda: overlap_reranker) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for queries, texts in batches:
            yield pd.Series(model([*zip(queries.fillna(""), texts.fillna(""))]), dtype="float64")

    return run(query, text)


def rerank(candidates: DataFrame, score: Column, final_k: int, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """The final_k candidates per query by score; equal scores keep their order of retrieval."""
    rows = candidates.withColumn("score", score).withColumn("retrieval_rank", F.col(rank))
    again = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc("retrieval_rank")))
    return rows.withColumn(rank, again).filter(F.col(rank) <= final_k)


def context(url: Column, text: Column) -> Column:
    return F.concat(F.lit("[source] "), F.coalesce(url, F.lit("")), F.lit("\n"), text)


def assembled(hits: DataFrame, query_id: str = "query_id", rank: str = "rank", context_col: str = "context", separator: str = "\n\n---\n\n") -> DataFrame:
    """(query_id, contexts): a query's contexts in order of rank. Ranks are bounded by the search's k."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(context_col).alias("c"))))
    return hits.groupBy(query_id).agg(F.array_join(F.transform(rows, lambda x: x["c"]), separator).alias("contexts"))


PROMPT = "Use nothing but the sources below. If they do not hold the answer, say that it was not found.\nBe brief, write in the language of the question, and name the addresses of the sources used.\n\nQuestion: %s\n\nSources:\n%s"


def prompt(question: Column, contexts: Column) -> Column:
    return F.format_string(PROMPT, question, contexts)


class Generator(Protocol):
    def __call__(self, prompt: str) -> str: ...


def answer(questions: DataFrame, hits: DataFrame, make: Callable[[], Generator] | None = None) -> DataFrame:
    """(query_id, query, prompt, sources, answer). questions: query_id, query; hits: query_id, rank, url, text.

    Without a generator, which is a connector, the answer is null.
    """
    rows = hits.withColumn("context", context(F.col("url"), F.col("text")))
    urls = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]))
    both = assembled(rows).join(rows.groupBy("query_id").agg(urls.alias("sources")), "query_id")
    out = questions.join(both, "query_id", "left").withColumn("prompt", prompt(F.col("query"), F.coalesce("contexts", F.lit(""))))
    if make is None:
        return out.select("query_id", "query", "prompt", "sources", F.lit(None).cast("string").alias("answer"))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield batch.map(model)

    return out.select("query_id", "query", "prompt", "sources", run("prompt").alias("answer"))


def search(vectors: DataFrame, questions: DataFrame, embed: Callable[[Column], Column], options: Options = Options(), score: Callable[[Column, Column], Column] = rerank_scores, where: Column | None = None) -> DataFrame:
    """Hits of all questions (query_id long, query): query_id, rank, id, url, text, preview, score.

    vectors: VECTOR rows. options.mode plain: top_k by similarity, score being (cos + 1) / 2; rerank (and auto, as
    a reranker is always there): initial_k candidates, reranked, cut to final_k. where: a filter on vectors.
    """
    if options.mode not in ("plain", "rerank", "auto"):
        raise ValueError(f"no such mode: {options.mode}")
    plain = options.mode == "plain"
    vectors = cut(vectors.filter(where) if where is not None else vectors, "vectors")
    # Ids are strings; their hash stands for them in the search, and finds them again.
    key = F.xxhash64("id")
    asked = cut(questions.select("query_id", embed(F.col("query")).alias("query_vector")), "questions")
    hits = top_k_many(vectors.select(key.alias("key"), "embedding"), asked, options.top_k if plain else options.initial_k, "key")
    texts = vectors.select(key.alias("key"), "id", "text", F.col("metadata.url").alias("url"))
    hits = hits.join(texts, "key").join(questions, "query_id")
    hits = hits.withColumn("score", V.score01(F.col("sim"))) if plain else rerank(hits, score(F.col("query"), F.col("text")), options.final_k)
    return hits.select("query_id", "rank", "id", "url", "text", T.preview(F.col("text")).alias("preview"), "score")
