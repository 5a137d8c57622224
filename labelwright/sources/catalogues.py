"""Catalogue and chunk files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.types import CHECK, CHUNK, EVAL_CASE, INTENT, RULE


def _nested(spark: SparkSession, path: str, key: str, ddl: str) -> DataFrame:
    """Rows of a JSON file: a bare list, or a list under ``key``; numbered in file order."""
    fields = spark.createDataFrame([], ddl).schema.simpleString()
    whole = spark.read.text(path, wholetext=True)
    inner = F.from_json("value", f"struct<{key}:array<{fields}>>")[key]
    rows = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{fields}>")).otherwise(inner)
    return whole.select(F.posexplode(rows).alias("catalogue_ord", "_r")).select("catalogue_ord", "_r.*")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return _nested(spark, path, "rules", RULE)


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    return _nested(spark, path, "checks", CHECK)


def read_intents(spark: SparkSession, path: str) -> list[dict]:
    """An intent catalogue as plain rows, for ``normalize_intent``."""
    rows = _nested(spark, path, "intents", INTENT).orderBy("catalogue_ord").collect()
    return [{k: v for k, v in r.asDict(recursive=True).items() if k != "catalogue_ord"} for r in rows]


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return _nested(spark, path, "cases", EVAL_CASE)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks dumped as one JSON list, the order of which is the insertion order.

    A list is one record, so this is for catalogues of a few megabytes; a corpus
    comes as lines or as Parquet.
    """
    return _nested(spark, path, "chunks", CHUNK).withColumnRenamed("catalogue_ord", "insert_ord")


def read_chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """A chunk corpus of any size as JSON lines, each with its ``insert_ord``; files split over tasks."""
    return spark.read.schema(f"{CHUNK}, insert_ord bigint").json(path)


def read_chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """A chunk corpus as written by ``write_chunks``."""
    return spark.read.parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The index on disk: Parquet, clustered by rule so that reference lookups skip files."""
    chunks.repartitionByRange("rule", "insert_ord").write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
