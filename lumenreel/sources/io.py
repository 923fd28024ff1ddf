"""Scans and sinks.  Schemas are given, never inferred; all paths go through Spark's readers and writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.functions.text import text_or_null
from lumenreel.operators.scenes import REPORT
from lumenreel.sources.arrays import elements
from lumenreel.sources.folders import scratch  # noqa: F401

METADATA = (
    "segment_id string, video_id string, spot_name string, place_name string, place_id string, region string, drama_title string, season string, "
    "time_of_day string, description string, start_time double, end_time double, keyframe_path string, mood array<string>, scene_elements array<string>, activity array<string>"
)
NUMERIC = {"candidate_start", "candidate_end", "total_score", "sharpness_score", "season_score"}
FLAGS = {"accepted", "season_verified", "season_match_required"}
REPORT_SCHEMA = ", ".join(f"{c} {'double' if c in NUMERIC else 'boolean' if c in FLAGS else 'string'}" for c in REPORT)


def read_metadata(spark: SparkSession, path: str, schema: str = METADATA) -> DataFrame:
    """Items of JSON array files with ``item_idx``, their order; a byte-order mark is accepted.

    A large file is read by many tasks (see ``arrays``).  An element that is not an object of fitting types is an error.
    """
    rows = elements(spark, path)
    parsed = F.from_json("item", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    bad = F.when(~F.col("item").startswith("{") | F.col("x._corrupt").isNotNull(), F.raise_error(F.lit("the file is not an array of objects"))).otherwise(F.col("item_idx"))
    return rows.withColumn("x", parsed).withColumn("item_idx", bad).select("x.*", "item_idx").drop("_corrupt")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(item_idx, item): array elements as variants with their number in their file, for validation."""
    return elements(spark, path, ordinals=True).select("item_idx", F.parse_json("item").alias("item"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can list a path."""
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A quality report (CSV with header); empty if there is none yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], REPORT_SCHEMA)
    return spark.read.schema(REPORT_SCHEMA).option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.select(*REPORT).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_outputs(tables: Mapping[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Several results, each in a folder of its own."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").format(form).save(f"{folder}/{name}")


def read_manifest(records: DataFrame, rules_present: bool, equal: Mapping[str, str] | None = None, first: int | None = None, order: str = "idx") -> DataFrame:
    """Records with a usable ``youtube_id`` that meet equality filters; the first ``first`` in order, if given."""
    if not rules_present:
        raise ValueError("the manifest has no quality_rules")
    rows = records.filter(text_or_null(F.col("youtube_id")).isNotNull())
    for c, v in (equal or {}).items():
        rows = rows.filter(F.col(c) == v)
    return rows if first is None else rows.orderBy(order).limit(first)


def list_assets(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path): files below a folder, relative to it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    return files.select(F.regexp_replace("path", F.lit("^.*" + root.rstrip("/").split(":")[-1].lstrip("/") + "/"), F.lit("")).alias("path"))
