"""The vector table: embedding, insertion of new ids, deletion and replacement by source, counts."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..storage import cut, exists
from .dedup import keep_first_wide, not_seen


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row of unit length per text."""


class HashEmbedder:
    """Offline default: hashed character n-grams, normalised."""

    def __init__(self, width: int = 64, sizes: tuple[int, ...] = (2, 3)) -> None:
        self.width, self.sizes = width, sizes

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for row, text in zip(out, texts):
            low = " ".join((text or "").lower().split())
            for n in self.sizes:
                for i in range(len(low) - n + 1):
                    h = zlib.crc32(low[i : i + n].encode("utf-8", "replace"))
                    row[h % self.width] += 1 if h & 0x80000000 else -1
            row /= np.linalg.norm(row) or 1
        return out


def embed(text: Column, make: Callable[[], Embedder] = HashEmbedder) -> Column:
    """array<float>; the model is made once per stream of batches, and called once per Arrow batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series([*model(batch.fillna("").tolist())])

    return run(text)


#: How similarities of the vectors are meant; the table says so itself, in the metadata of its embedding column.
METRIC = "cosine"


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The table, or an empty one if there is none yet."""
    return spark.read.schema(S.VECTOR).parquet(path) if exists(spark, path) else spark.createDataFrame([], S.VECTOR)


def declared_metric(spark: SparkSession, path: str) -> str | None:
    """The metric that the table at path was made for; null if it doesn't say."""
    return spark.read.parquet(path).schema["embedding"].metadata.get("metric")


def _declared(vectors: DataFrame, metric: str = METRIC) -> DataFrame:
    return vectors.withColumn("embedding", F.col("embedding").alias("embedding", metadata={"metric": metric}))


def load(spark: SparkSession, path: str, records: DataFrame, make: Callable[[], Embedder] = HashEmbedder) -> dict[str, int]:
    """Embeds the records (EMBEDDABLE) whose ids the table at path lacks and appends them; of equal new ids, one.

    Returns how many were added, and how many rows the table then has. A table that was made for
    another metric is an error.
    """
    old = read_vectors(spark, path)
    if exists(spark, path) and (other := declared_metric(spark, path)) not in (None, METRIC):
        raise ValueError(f"the table at {path} is for {other}, not {METRIC}")
    once = keep_first_wide(records.select("id", "text", "metadata"), "id", ["text", "metadata"])
    fresh = cut(new_vectors(once, old, make), "fresh")
    added, before = fresh.count(), old.count()
    if added or not exists(spark, path):
        _declared(fresh).write.mode("append").parquet(path)
    return {"added": added, "total": before + added}


def new_vectors(records: DataFrame, vectors: DataFrame, make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """VECTOR rows of the records (EMBEDDABLE) whose ids the table lacks: ids that are there stay as they are.

    What is there is left out before anything is embedded.
    """
    fresh = not_seen(records, vectors, "id")
    return fresh.select("id", "text", "metadata", embed(F.col("text"), make).alias("embedding"))


def without_source(vectors: DataFrame, url: str) -> DataFrame:
    """The table less everything of one source."""
    return vectors.filter(~F.col("metadata.url").eqNullSafe(F.lit(url)))


def replaced(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table with all rows of the sources that `fresh` has replaced by it."""
    old = vectors.withColumn("_url", F.col("metadata.url"))
    return not_seen(old, fresh.select(F.col("metadata.url").alias("_url")).distinct(), "_url").drop("_url").unionByName(fresh)


def count_source(vectors: DataFrame, url: str) -> int:
    return vectors.filter(F.col("metadata.url") == url).count()


def rewrite(df: DataFrame, path: str) -> None:
    """Puts df in place of the table at path, which df may read.

    It is written beside the table first. The old table is then moved aside, the new one moved in, and
    only then the old one deleted; if the second move fails, the old one is moved back.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    mark = uuid.uuid4().hex
    at, fresh, aside = (hadoop.Path(path.rstrip("/") + x) for x in ("", f".new-{mark}", f".old-{mark}"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _declared(df).write.parquet(fresh.toString())
    there = fs.exists(at)
    if there and not fs.rename(at, aside):
        raise OSError(f"{path} can't be moved aside; its replacement is at {fresh}")
    if not fs.rename(fresh, at):
        if there:
            fs.rename(aside, at)
        raise OSError(f"{path} can't be replaced; its replacement is at {fresh}")
    if there:
        fs.delete(aside, True)


def delete_source(spark: SparkSession, path: str, url: str) -> int:
    """Deletes one source's vectors from the table at path, and returns how many there were."""
    vectors = read_vectors(spark, path)
    n = count_source(vectors, url)
    if n:
        rewrite(without_source(vectors, url), path)
    return n


def update_source(spark: SparkSession, path: str, records: DataFrame, make: Callable[[], Embedder] = HashEmbedder) -> int:
    """Replaces what the records' sources have in the table at path; returns the new number of their vectors."""
    fresh = cut(records.select("id", "text", "metadata", embed(F.col("text"), make).alias("embedding")), "fresh")
    rewrite(replaced(read_vectors(spark, path), fresh), path)
    return fresh.count()
