"""Mixing sources to target weights by capped water-filling.

Each source asks for a share of the mix by its weight and can give at most ``max_epochs`` times its own size.  Shares
above that cap are clamped, and their excess is handed out again by weight, until none is above.  A source's target is
then met by whole repetitions of all its documents and one fractional repetition, which takes documents in a seeded
order until the target is reached; the document at the boundary gives only the words still missing.

The seeded order of a source is never sorted as a whole: documents fall into ``buckets`` by the leading bits of a hash,
bucket sums tell which buckets are in or out, and only the boundary bucket's rows are ordered.

Null texts have size 0; a null source is a source of its own and comes last; sizes of 0 give targets of 0.  Repeated rows
are separate rows.  Rows without ``doc_id`` are mixed like others.  An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.llm.common import cut, global_rank, n_words


def source_targets(sources: DataFrame, weights: Sequence[float], percent: int, max_epochs: float) -> DataFrame:
    """``sources(source, source_size)`` with ``target``; weights repeat over the sources in code-point order, null last.

    Each round is one aggregation over the source table; only its three sums reach the driver.
    """
    ranked = cut(global_rank(sources, F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap"))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    level, clamped = 0.0, None
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("cap")
        full, n, free = ranked.agg(F.sum(F.when(above, F.col("cap"))), F.count_if(above), F.sum(F.when(~above, F.col("weight")))).first()
        if n == clamped or not free:
            break
        clamped, level = n, max(level, (total - (full or 0.0)) / free)
    target = F.when(F.col("weight") * F.lit(level) >= F.col("cap"), F.col("cap")).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", (target if free else F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), percent: int = 150, max_epochs: float = 2, seed: int = 20, buckets: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document of ``docs(doc_id, text, source)``: doc_id, size, source_size, target, taken (words).

    ``percent``: size of the mix in hundredths of all words.  ``buckets``: by default as many as keep a bucket below
    about 100,000 rows, and 1024 at least.  ``carry``: more columns of ``docs`` to return.
    """
    u = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long"), "source", n_words(F.col("text")).alias("size"), u.alias("u"), *([F.struct(*carry).alias("more")] if carry else []))
    light = cut(rows.drop("more"))
    if buckets is None:
        buckets = 1 << max(10, (light.count() // 100_000).bit_length())
    rows, light = (df.withColumn("bucket", F.pmod("u", F.lit(buckets)).cast("int")) for df in (rows, light))
    parts = cut(light.groupBy("source", "bucket").agg(F.sum("size").alias("part")))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, percent, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    targets = targets.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))

    same = lambda x, y: F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source"))
    before = F.sum("part").over(W.partitionBy("source").orderBy("bucket")) - F.col("part")  # at most `buckets` rows a source
    parts = parts.withColumn("before", before).alias("p").join(targets.alias("t"), same("p", "t"))
    parts = cut(parts.select("p.source", "p.bucket", "part", "source_size", "target", "whole", (F.col("rest") - F.col("before")).alias("left")))

    # In a boundary bucket, and only there, rows are put in order: up to which hash they are taken, and what the last gives.
    edge = parts.filter("left > 0 and left < part").alias("e")
    close = light.alias("r").join(edge, same("r", "e") & (F.col("r.bucket") == F.col("e.bucket"))).groupBy("r.source", "r.bucket", "u").agg(F.sum("size").alias("size"), F.count("*").alias("m"), F.first("left").alias("left"))
    close = close.withColumn("before", F.sum("size").over(W.partitionBy("source", "bucket").orderBy("u")) - F.col("size")).filter("before < left and left <= before + size")
    close = close.select("source", "bucket", F.col("u").alias("last"), F.floor((F.col("left") - F.col("before")) / F.col("m")).alias("some"))  # repeated rows share
    parts = cut(parts.alias("p").join(close.alias("c"), same("p", "c") & (F.col("p.bucket") == F.col("c.bucket")), "left").select("p.*", "last", "some"))

    all_ = (rows if carry else light).alias("r").join(parts.alias("p"), same("r", "p") & (F.col("r.bucket") == F.col("p.bucket")))
    part = F.when(F.col("left") >= F.col("part"), F.col("size")).when((F.col("left") <= 0) | (F.col("u") > F.col("last")), 0).when(F.col("u") < F.col("last"), F.col("size")).otherwise(F.col("some"))
    out = all_.withColumn("taken", (F.col("whole") * F.col("size") + part).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "taken", *(F.col("more")[c].alias(c) for c in carry))
