"""Tables and small expressions shared by the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.session import ensure_checkpoint_dir, spread


def table(spark: SparkSession, folder: str, name: str, even: bool = False) -> DataFrame:
    """A table of the data folder; ``even`` gives a small file one task per core."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if even else df


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run, where every executor can write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def money(c: str | Column) -> Column:
    """A price as text with two decimals."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("decimal(12,2)").cast("string")


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def case(n: Column, *choices: Column) -> Column:
    """The choice at position ``n``."""
    out = F
    for i, c in enumerate(choices[:-1]):
        out = out.when(n == i, c)
    return out.otherwise(choices[-1])


def seconds(ts: str = "ts") -> Column:
    """Seconds since the first day of the event table."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})")


SECONDS_SQL = "CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0) AS BIGINT)"
