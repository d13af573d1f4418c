"""Incremental ingestion: documents arrive as files, and each content is kept once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.dedup import dedup_incremental, known_hashes
from ..storage import exists


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, key: str = "content_hash", order: str = "id", transform: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """Appends to the table at `out` what each batch brings that it lacks, until all files are read.

    The table itself is the state, so it does not grow in memory. Each batch has a folder of its own,
    which is overwritten if the batch is tried again: then it is compared with the other batches only.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = None
        if exists(spark, f"{out}/batch=*"):
            there = spark.read.option("basePath", out).parquet(out).filter(f"batch <> {number}")
            seen = known_hashes(there.withColumnRenamed(key, "content_hash")).withColumnRenamed("content_hash", key)
        fresh = dedup_incremental(transform(batch), seen, key, order)
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
