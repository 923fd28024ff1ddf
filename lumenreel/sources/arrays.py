"""JSON array files that are read by many tasks: element boundaries are found in parallel.

Spark's text reader cuts files into chunks by offset and chunks into pieces behind each ``}``.  Whether a chunk begins inside
a string, and how deep in brackets, follows from what is before it: a first pass sums up each chunk for both cases, the few
sums of a file are put in order, and a second pass, which then knows where every chunk begins, cuts out the elements of the
top-level array.  Only elements that cross the end of a chunk are put together afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.sources.folders import kept

#: Rows of about 200 bytes, one a chunk, that are sent to all tasks.
MOST_CHUNKS = 200_000
_STRUCTURE = re.compile(r'["\[\]{},]')
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_OPEN, _CLOSE = frozenset("[{"), frozenset("]}")


def tokens(text: str, inside: bool) -> Iterator[tuple[int, str]]:
    """(place, character) of brackets and commas outside strings, and of the string's ends as ``"``; last (length, "in" or "out")."""
    at = 0
    while True:
        if inside:
            m = _STRING_END.match(text, at)
            if not m:
                yield len(text), "in"
                return
            at, inside = m.end(), False
            yield at - 1, '"'
        m = _STRUCTURE.search(text, at)
        if not m:
            yield len(text), "out"
            return
        at = m.end()
        yield m.start(), m[0]
        inside = m[0] == '"'


def summary(text: str, inside: bool) -> tuple[bool, int]:
    """(whether the text ends inside a string, change of depth) if it begins inside a string or not."""
    depth, end = 0, "out"
    for _, c in tokens(text, inside):
        depth += (c in _OPEN) - (c in _CLOSE)
        end = c
    return end == "in", depth


def cut_elements(text: str, inside: bool, depth: int) -> Iterator[tuple[str, str]]:
    """(kind, text) of the elements in a chunk that begins at ``depth``: ``whole`` ones, and parts of those that go beyond it.

    ``head`` ends an element of the chunk before, ``tail`` begins one, ``middle`` is the whole chunk inside of one.
    """
    start = 0 if depth > 1 or inside else None
    first = start is not None
    for at, c in tokens(text, inside):
        if c in ("in", "out"):
            break
        if depth == 0:
            if c == "[":
                depth, start = 1, at + 1
            continue
        if depth == 1 and c in ",]":
            part = text[start:at] if start is not None else ""
            if part.strip() or first:
                yield ("head" if first else "whole"), part
            first, start = False, at + 1
        elif depth == 1 and start is None:
            start = at
        depth += (c in _OPEN) - (c in _CLOSE)
        if depth == 0:
            return
    rest = text[start:] if start is not None and depth > 0 else ""
    if first:
        yield "middle", rest
    elif rest.strip():
        yield "tail", rest


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    """((file, block, ...), text) of each chunk; its pieces lie behind one another."""
    key, held = None, []
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for value, *k in zip(*columns, strict=True):
            if tuple(k) != key:
                if held:
                    yield key, "".join(held)
                key, held = tuple(k), []
            held += [value, "}"]  # behind a file's last piece it is one too many, and behind the array
    if held:
        yield key, "".join(held)


def elements(spark: SparkSession, path: str, ordinals: bool = False) -> DataFrame:
    """(item_idx, item): texts of the elements of all JSON array files at ``path``; ``item_idx`` is their order by file and place.

    With ``ordinals`` it is an element's number in its file, from 0: elements are then kept in the shared folder, counted by
    chunk, and numbered from the counts of the chunks before.  A byte-order mark is accepted; a file whose top level is not an array is an error.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(*key, *summary(text, False), *summary(text, True), text.lstrip("﻿ \t\r\n")[:1]) for key, text in _chunks(batches)]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "out_in", "out_d", "in_in", "in_d", "head"])

    found = pieces.mapInArrow(sums, "file string, block long, out_in boolean, out_d int, in_in boolean, in_d int, head string")
    found = found.toPandas().sort_values(["file", "block"])  # a row a chunk
    if len(found) > MOST_CHUNKS:
        raise ValueError(f"{len(found)} chunks are too many: raise spark.sql.files.maxPartitionBytes")
    starts, file, number = {}, None, -1
    for r in found.itertuples():
        if r.file != file:
            file, number, inside, depth = r.file, number + 1, False, 0
            if r.head != "[":
                raise ValueError("the top level is not an array")
        starts[r.file, r.block] = (inside, depth, number)
        inside, depth = (r.in_in, depth + r.in_d) if inside else (r.out_in, depth + r.out_d)
    known = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, block), text in _chunks(batches):
            inside, depth, no = known.value[name, block]
            parts = list(cut_elements(text.lstrip("﻿") if block == 0 else text, inside, depth))
            for i in range(0, len(parts), 10_000):
                some = parts[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(some), pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([block + i + k for k in range(len(some))], pa.int64()), *(pa.array([p[c] for p in some], pa.string()) for c in (0, 1))], ["file", "block", "at", "kind", "item"])

    rows = pieces.mapInArrow(cut, "file int, block long, at long, kind string, item string")
    if ordinals:
        rows = kept(rows)
    # Of an element in several chunks the parts follow its tail; at most one begins in a chunk.
    own = F.last(F.when(F.col("kind") == "tail", F.col("at")), ignorenulls=True).over(W.partitionBy("file").orderBy("at"))
    crossing = rows.filter("kind <> 'whole'").withColumn("_own", own).groupBy("file", "_own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]), "").alias("item"))
    both = rows.filter("kind = 'whole'").select("file", "at", "item").unionByName(crossing.select("file", F.col("_own").alias("at"), "item"))
    both = both.withColumn("item", F.btrim("item", F.lit(" \t\r\n")))
    if not ordinals:
        return both.select((F.shiftleft(F.col("file").cast("long"), 44) + F.col("at")).alias("item_idx"), "item")
    begun = F.col("kind").isin("whole", "tail")
    chunks = rows.groupBy("file", "block").agg(F.count_if(begun).alias("n"), F.min(F.when(begun, F.col("at"))).alias("first"), F.max("at").alias("last"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")
    chunks = F.broadcast(chunks.select(F.col("file").alias("_file"), "first", "last", before.alias("before")))  # a row a chunk
    same = (F.col("file") == F.col("_file")) & F.col("at").between(F.col("first"), F.col("last"))
    return both.join(chunks, same).select((F.col("before") + F.col("at") - F.col("first")).alias("item_idx"), "item")
