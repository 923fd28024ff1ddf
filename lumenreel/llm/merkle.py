"""Fixity audit of archive replicas by Merkle trees over offset ranges.

Leaves are the SHA-256 of records with their offsets.  A tree's lowest nodes hash the ordered leaves of one offset range
(``span`` bytes of a file); each higher node hashes ``fanout`` ordered neighbours, up to one root per file.  A range's
place follows from the offset alone, so no file is ever ordered or numbered as a whole, and what one group holds is
bounded by the records in ``span`` bytes or by ``fanout``.

Two replicas are compared from the roots down: only children of nodes that differ are looked at, and only in ranges that
differ are single records compared.  The levels are kept as tables, so an audit of equal replicas joins roots only.

Null bodies count as empty.  Records without a file or an offset cannot be placed and are reported as ``unplaced``.
Repeated records (same file and offset) are leaves of their own, ordered by hash.  Empty replicas have no roots; a record
that one replica lacks is reported as missing.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.llm.common import cut


def digest(body: Column) -> Column:
    return F.sha2(F.coalesce(body.cast("binary"), F.lit("").cast("binary")), 256)


def hashed(records: DataFrame, hash_column: str | None = None) -> DataFrame:
    """(file, offset, hash) of ``records(file, offset, body)``; of records that are hashed already, where ``hash_column`` says so."""
    return records.select("file", F.col("offset").cast("long"), (F.col(hash_column) if hash_column else digest(F.col("body"))).alias("hash"))


def leaves(records: DataFrame, hash_column: str | None = None) -> DataFrame:
    """(file, offset, hash) of the records that have a place."""
    return hashed(records, hash_column).filter("file is not null and offset is not null")


def tree(leaf: DataFrame, span: int = 1 << 20, fanout: int = 16, height: int | None = None) -> list[DataFrame]:
    """Levels (file, node, hash) from the offset ranges up to the roots; ``height``: number of levels, if given."""
    level = cut(leaf.groupBy("file", F.floor(F.col("offset") / span).alias("node")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("offset", "hash")))), 256).alias("hash")))
    levels = [level]
    top = level.agg(F.max("node")).first()[0] or 0
    while top > 0 if height is None else len(levels) < height:
        level = cut(level.groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("node", "hash")))), 256).alias("hash")))
        levels.append(level)
        top //= fanout
    return levels


def _unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), ["file", "node"], "full_outer").filter(~F.col("a.hash").eqNullSafe(F.col("b.hash"))).select("file", "node")


def audit(a: DataFrame, b: DataFrame, span: int = 1 << 20, fanout: int = 16, hash_column: str | None = None) -> DataFrame:
    """Records in which two replicas differ: file, offset, status, hash_a, hash_b.

    ``status``: ``differs``, ``missing_in_a``, ``missing_in_b``, or ``unplaced`` (no file or offset).
    ``hash_column``: a column of both replicas that has the bodies' SHA-256 already; without it bodies are hashed here.
    """
    a, b = cut(hashed(a, hash_column)), cut(hashed(b, hash_column))
    la, lb = leaves(a, "hash"), leaves(b, "hash")
    ta, tb = tree(la, span, fanout), tree(lb, span, fanout)
    height = max(len(ta), len(tb))
    ta, tb = (t if len(t) == height else tree(x, span, fanout, height) for t, x in ((ta, la), (tb, lb)))
    bad = cut(_unequal(ta[-1], tb[-1]))
    for va, vb in zip(ta[-2::-1], tb[-2::-1], strict=True):
        below = lambda v: v.withColumn("_up", F.floor(F.col("node") / fanout)).join(bad.withColumnRenamed("node", "_up"), ["file", "_up"], "left_semi").drop("_up")  # noqa: B023, E731
        bad = cut(_unequal(below(va), below(vb)))
    here = lambda x: x.withColumn("node", F.floor(F.col("offset") / span)).join(bad, ["file", "node"], "left_semi").withColumn("nth", F.row_number().over(W.partitionBy("file", "offset").orderBy("hash")))
    both = here(la).alias("a").join(here(lb).alias("b"), ["file", "offset", "nth"], "full_outer").filter(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
    status = F.when(F.col("a.hash").isNull(), "missing_in_a").when(F.col("b.hash").isNull(), "missing_in_b").otherwise("differs")
    found = both.select("file", "offset", status.alias("status"), F.col("a.hash").alias("hash_a"), F.col("b.hash").alias("hash_b"))
    none = F.lit(None).cast("string")
    lost = [x.filter("file is null or offset is null").select("file", "offset", F.lit("unplaced").alias("status"), (none if k else F.col("hash")).alias("hash_a"), (F.col("hash") if k else none).alias("hash_b")) for k, x in enumerate((a, b))]
    return found.unionByName(lost[0]).unionByName(lost[1])


def with_offsets(rows: DataFrame, order: str) -> DataFrame:
    """``rows(file, length, ...)`` with their ``offset`` in the file, in ``order``.  Lengths suffice: bodies need not be moved."""
    before = W.partitionBy("file").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def warc_bodies(pages: DataFrame, per_file: int = 500) -> DataFrame:
    """(page_id, body, file): each page as a WARC response record, ``per_file`` consecutive ids in a file."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.filter("page_id is not null").select(F.col("page_id").cast("long"), F.concat(head, html, F.lit("\r\n\r\n")).alias("body")).withColumn("file", F.floor(F.col("page_id") / per_file))


def warc_records(pages: DataFrame, per_file: int = 500) -> DataFrame:
    """(page_id, body, file, length, offset): the records with their places."""
    return with_offsets(warc_bodies(pages, per_file).withColumn("length", F.octet_length("body")), "page_id")
