"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A run of ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Narrow rows that one task of ``few_tasks`` takes, and the least number of its tasks.
ROWS_A_TASK = 100_000
LEAST_TASKS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; a local session may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: a lost executor costs a reread, not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few_tasks(df: DataFrame, n: int) -> DataFrame:
    """``df``, of at most ``n`` narrow rows, in as many tasks as they need: each further one costs files in every shuffle."""
    return df.coalesce(max(LEAST_TASKS, n // ROWS_A_TASK))


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], by: Column, salts: int = 32) -> DataFrame:
    """Inner join with a ``table`` of one row a key, in which the rows of a hot key meet in up to ``salts`` tasks.

    ``by``: what spreads the rows of a key.  A row of ``table`` is copied only to the shares that have rows for it, so
    keys with a single row cost nothing more.
    """
    rows = rows.withColumn("_share", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    wanted = table.join(rows.select(*keys, "_share").distinct(), keys)
    return rows.join(wanted, [*keys, "_share"]).drop("_share")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null.  Every white-space character becomes a space, so that a plain split counts."""
    parts = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")
    return F.coalesce(F.size(F.array_remove(parts, "")).cast("long"), F.lit(0).cast("long"))


def held_out(doc_id: Column) -> Column:
    """True where the crc32 of the id as text is a multiple of 5; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rows numbered from 0 in the given total order, without bringing them into one task.

    Rows are range-partitioned and numbered inside their partition; one row per *partition* then gives the offsets,
    so what meets in one task is bounded by the number of shuffle partitions.
    """
    from pyspark.sql import Window as W

    part, row = F.shiftright(F.col("_mono"), 33), F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mono", F.monotonically_increasing_id()))
    seen = seen.withColumn("_part", part)
    sizes = seen.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))
    return seen.join(before, "_part").withColumn(name, F.col("_before") + row).drop("_mono", "_part", "_before")
