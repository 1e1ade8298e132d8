"""Scans of the driver's parquet tables (column-pruned, lazily planned)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only the columns the views need; the parquet reader prunes the rest.
    return read_table(spark, sf_dir, "events").select(*EVENT_COLUMNS)
