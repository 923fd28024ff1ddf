"""A training corpus from raw documents: quality rules, line dedup, near duplicates, source mix, packed sequences.

Each stage takes the documents that its predecessor kept and returns the columns of ``documents``, except the last, which
returns packed pieces.  Stages take nulls in any column, repeated ids and rows, empty tables, and further columns of any
name, which they return as they are.  ``run`` writes each result as Parquet to the folder that the executors share
(``spark.checkpoint.dir``) and reads it again, so that a lost executor costs a reread.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import global_rank, shared_folder
from lumenreel.llm.jaccard_join import near_duplicates
from lumenreel.llm.line_dedup import remove_boilerplate
from lumenreel.llm.mixing import mix
from lumenreel.llm.packing import pack
from lumenreel.llm.quality import group_of, judge
from lumenreel.llm.queries import word_tokenizer

_SPACES = "\t\n\x0b\x0c\r "


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that fail a base rule or are outliers of their language and source."""
    bad = judge(docs).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("grp").alias("_grp")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), group_of().alias("grp"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")) & (F.col("grp") == F.col("_grp"))
    return rows.join(bad, same, "left_anti").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without boilerplate lines, but for their first place; a document that has lost all its words goes.

    Any text that is left stays, as it may be the only copy of a body below a long template.
    """
    rows = remove_boilerplate(docs)
    empty = (F.col("n_removed") > 0) & (F.translate("text", _SPACES, "") == "")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return rows.filter(~F.coalesce(empty, F.lit(False))).select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the smallest doc_id.

    Where ids are null or repeated, documents are numbered by id and text instead: texts that differ are documents of
    their own, equal texts under one id are one.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    odd = not rows.groupBy("id").count().filter("id is null or count > 1").isEmpty()
    if odd:
        keys = global_rank(rows.select(F.col("id").alias("_id"), F.col("hash").alias("_hash")).distinct(), F.asc_nulls_last("_id"), F.col("_hash"))
        rows = rows.join(keys, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("row", F.col("rank").alias("id"))
    found = near_duplicates(rows.select(F.col("id").alias("doc_id"), "row.text"), k=5, percent=80)
    kept = rows.join(found.filter("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    if odd:
        plain = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # others have no hash
        kept = kept.groupBy("id").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return kept.select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, and one of the words of a fractional copy at a source's boundary."""
    taken = mix(docs.withColumn("_row", F.struct("*")), carry=["_row"])
    size = F.greatest("size", F.lit(1))
    text = F.col("_row.text")
    words = F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")
    rest = (F.col("taken") % size).cast("int")
    part = F.when(rest > 0, F.array(F.array_join(F.slice(words, F.lit(1), rest), " "))).otherwise(F.array().cast("array<string>"))
    rows = taken.select("_row", F.explode(F.concat(F.array_repeat(text, F.floor(F.col("taken") / size).cast("int")), part)).alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_text") == F.col("_row.text"), F.col("_row.n_chars")).otherwise(F.length("_text"))}
    return rows.select(*(new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of at most 2048 tokens."""
    return pack(docs.drop("loss_tokens"), word_tokenizer)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard_join", ngram_jaccard_join), ("mixing", mixing), ("packing", packing)]
#: Robust estimates, seeded hashes and token ids have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
