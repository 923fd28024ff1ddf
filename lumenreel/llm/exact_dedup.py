"""Exact deduplication on normalised texts, safe for hot groups of copies.

Texts are equal when identical after each run of ASCII white space has become one space; null counts as empty.  Of equal
texts the row with the smallest ``doc_id`` stays.  The work is combined in three steps, each of which groups on the
digest *and* the full content, so no step trusts a digest alone:

1. every map task combines its own rows before anything is shuffled;
2. rows of one digest are merged in ``salts`` shares, so that a group with a third of all rows meets in many tasks;
3. the shares' winners, at most ``salts`` rows a content, are merged to one row a content.

Rows then look up their group by (digest, share), without their text.  A digest that turned out to belong to one content
needs no further comparison; digests that several contents share are looked up by content instead.

Rows without ``doc_id`` count in their group; one of them stays only if the group has no id at all.  Of repeated rows
(same id, same text) one stays.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.llm.common import SPACE, cut


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _share(doc_id: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int")


def exact_duplicates(docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` only decides where rows meet; results do not depend on it.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ").alias("content"))
    rows = rows.select("doc_id", "content", digest(F.col("content")).alias("digest"), _share(F.col("doc_id"), salts).alias("share"))

    shares = rows.groupBy("digest", "share", "content").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    contents = shares.repartition("digest").groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    groups = cut(contents.groupBy("digest").agg(F.count("*").alias("contents"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")))

    one = groups.filter("contents = 1").select("digest", "keep_id", "group_size")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    one = one.withColumn("share", F.explode(F.when(F.col("group_size") > 1, every).otherwise(F.array(_share(F.col("keep_id"), salts)))))
    found = rows.select("doc_id", "digest", "share", sha256(F.col("content")).alias("text_sha256")).join(one, ["digest", "share"])
    clash = groups.filter("contents > 1").select("digest")
    if not clash.isEmpty():
        mine = contents.join(clash, "digest", "left_semi").select("digest", "content", "keep_id", F.col("n").alias("group_size"))
        mine = mine.withColumn("share", F.explode(every))
        more = rows.join(clash, "digest", "left_semi").join(mine, ["digest", "share", "content"])
        found = found.unionByName(more.select("digest", "share", "doc_id", sha256(F.col("content")).alias("text_sha256"), "keep_id", "group_size"))

    # Of repeated rows one stays: the first of each share, and of these the first; others can no longer be the one.
    part = F.pmod(F.monotonically_increasing_id(), F.lit(salts * salts))
    nth = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("part"))
    found = found.select("doc_id", "keep_id", "group_size", "text_sha256", part.alias("part"))
    found = cut(found.withColumn("nth", nth("doc_id", "text_sha256", "part")))
    first = found.filter("nth = 1").withColumn("nth", nth("doc_id", "text_sha256"))
    kept = (F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = first.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    return out.unionByName(found.filter("nth > 1").select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "text_sha256"))
