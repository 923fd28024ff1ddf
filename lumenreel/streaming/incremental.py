"""Resumable processing of records: batch by an anti-join with what is done, or as a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.operators import tables as T
from lumenreel.sources.folders import kept
from lumenreel.sources.io import exists, list_assets
from lumenreel.streaming.records import failed, not_failed


def pending(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records that are not completed yet."""
    return T.without(records, done.filter(F.col("status") == "completed"), key)


def run_batch(records: DataFrame, results: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Earlier results and those of pending records; with ``force`` all records run anew and replace their results.

    ``process`` returns rows with ``status``: failed records are rows like others and do not stop the run.  Where records go
    through a function of their own, ``records.isolated`` makes such rows of what it raises.  What ``process`` returns is
    kept in the shared folder, so that it runs once; ``results`` are read twice.
    """
    todo = records if force else pending(records, results, key)
    return T.replace_keys(results, kept(process(todo)), key)


def run_stream(spark: SparkSession, source: str, schema: str, key: str, order: str, update: list[str], store: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] = lambda x: x, files: int = 100, buckets: int = 16) -> None:
    """Upsert all files that have arrived in ``source`` into the keyed table under ``store``, ``files`` a micro-batch.

    Keys are hashed into ``buckets``; a batch writes the buckets that it touches anew and leaves the others where they
    are.  The stream's checkpoint remembers which files are done.  A bucket's version is named by its batch and made from
    older ones, so a batch that is run again after a failure writes the same files again.  Rows without a key are left
    out, and a row whose ``order`` is not above what its key has changes nothing.  Rows that ``process`` gives as ``failed``
    (a ``status`` column, as of ``records.isolated``) are put into the stream's quarantine instead of the table, and the
    stream goes on.
    """

    def merge(rows: DataFrame, batch: int) -> None:
        rows = process(rows)
        if "status" in rows.columns:
            rows = kept(rows)  # a record's function runs once
            failed(rows).write.mode("overwrite").parquet(f"{store}-quarantine/batch={batch}")
            rows = not_failed(rows)
        rows = T.last_of(rows.filter(F.col(key).isNotNull()), key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = {r.bucket for r in rows.select("bucket").distinct().collect()}  # at most `buckets`
        old = _newest(spark, store, batch, touched)
        if old is not None:
            was = old.select(key, F.col(order).alias("_was"))
            rows = rows.join(was, key, "left").filter(F.col("_was").isNull() | (F.col(order) > F.col("_was"))).select(*old.columns)
            rows = T.upsert(old, rows, key, update)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={batch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _newest(spark: SparkSession, store: str, before: int | None = None, only: set[int] | None = None) -> DataFrame | None:
    """The newest version of each bucket, by the names of the store's folders; None if there is nothing."""
    if not exists(spark, store):
        return None
    part = lambda name: F.regexp_extract("path", rf"{name}=(\d+)", 1).cast("int").alias(name)
    found = list_assets(spark, store, "*.parquet").select(part("batch"), part("bucket"))
    found = found.filter(F.col("batch") < before) if before is not None else found
    newest = found.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # one row a bucket
    paths = [f"{store}/batch={r.batch}/bucket={r.bucket}" for r in newest if only is None or r.bucket in only]
    return spark.read.option("basePath", store).parquet(*paths).drop("batch") if paths else None


def quarantined(spark: SparkSession, store: str) -> DataFrame:
    """All records that failed in a stream, with ``batch``; an error if the stream has no statuses."""
    return spark.read.option("basePath", f"{store}-quarantine").option("recursiveFileLookup", False).parquet(f"{store}-quarantine")


def latest(spark: SparkSession, store: str) -> DataFrame:
    """The table that a stream has written so far."""
    rows = _newest(spark, store)
    if rows is None:
        raise ValueError(f"{store} has no table yet")
    return rows.drop("bucket")
