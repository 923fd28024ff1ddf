"""Shared by the registered queries: tables, and series derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of one series per user: video_id, event_id, t (seconds), value, event_type."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", t.alias("t"), "value", "event_type", "props")


#: The same in DuckDB.
SERIES = "s AS (SELECT user_id AS video_id, event_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value, event_type, props FROM events)"
