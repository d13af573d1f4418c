"""JSON-lines tables of the pipeline: declared schemas, malformed lines counted or fatal, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schema as S

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = False) -> DataFrame:
    """Records of a JSON-lines table; blank lines are skipped. strict: a malformed line is an error; else its row has only CORRUPT."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = lines.select(F.from_json("value", full, {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")
    return rows.drop(CORRUPT) if strict else rows


def well_formed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def manifest_pages(manifest: DataFrame) -> DataFrame:
    """url (the canonical one) and path of every page row that has both."""
    rows = manifest.filter((F.col("record") == "page") & (F.coalesce("html_path", F.lit("")) != "") & (F.coalesce("canonical", F.lit("")) != ""))
    return rows.select(F.col("canonical").alias("url"), F.col("html_path").alias("path"), "ts")


def manifest_assets(manifest: DataFrame, kind: str) -> DataFrame:
    """url, path, page, alt and src_hint of every asset row of a kind (pdf or image) that has url and path."""
    rows = manifest.filter((F.col("record") == "asset") & (F.col("asset_type") == kind) & (F.coalesce("path", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    return rows.select("url", "path", "page", F.coalesce("alt", F.lit("")).alias("alt"), F.coalesce("src_hint", F.lit("")).alias("src_hint"), "ts")


def with_content(rows: DataFrame, files: DataFrame, by_name: bool = False) -> DataFrame:
    """rows whose file exists, with its content. files: path and content as the binaryFile source gives them.

    A file is a row's if its path ends with the row's path, folders included (schemes and leading dots
    don't count). by_name: the file's name alone counts, for tables that were moved; names that occur
    in several folders are an error then.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", ""), r"^(\.?/)+", "")
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    there = files.select(plain(F.col("path")).alias("_file"), "content").withColumn("_name", name(F.col("_file")))
    wanted = rows.withColumn("_path", plain(F.col("path"))).withColumn("_name", name(F.col("_path")))
    if by_name:
        twice = there.groupBy("_name").agg(F.count_distinct("_file").alias("n")).filter("n > 1")
        if row := twice.first():
            raise ValueError(f"{row['n']} files are named {row['_name']}")
        found = wanted.join(there, "_name")
    else:
        same = (F.col("_file") == F.col("_path")) | F.col("_file").endswith(F.concat(F.lit("/"), F.col("_path")))
        found = wanted.join(there, "_name").filter(same)
    return found.select(*rows.columns, "content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, S.DOCUMENT)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, S.CHUNK)


def read_embeddables(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a malformed line is an error."""
    return read_jsonl(spark, path, S.EMBEDDABLE, strict=True)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """UTF-8 lines as they are, not escaped; nulls are written, so that every record has all keys."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)
