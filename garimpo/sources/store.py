"""Provenance tables: append-only folders with a current view, for experiments and their executions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.operators.labels import latest_rows

#: Every row carries the time it was written and whether it deletes its key.
TIME, GONE = "gravado_em", "apagado"


def append(df: DataFrame, path: str, gone: bool = False) -> None:
    """Add rows (inserts and updates alike, or deletions by key) without touching what is there."""
    df.withColumns({TIME: F.current_timestamp(), GONE: F.lit(gone)}).write.mode("append").option("mergeSchema", "true").parquet(path)


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key, without deleted keys."""
    return latest_rows(spark.read.option("mergeSchema", "true").parquet(path), keys, [TIME]).where(~F.col(GONE)).drop(TIME, GONE)


def compact(spark: SparkSession, path: str, keys: list[str], to: str) -> None:
    """Write the current view as a new folder, to be put in place of the old one."""
    current(spark, path, keys).withColumns({TIME: F.current_timestamp(), GONE: F.lit(False)}).write.parquet(to)
