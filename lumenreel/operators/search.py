"""Cosine searches over segments and their keyframes.

Distances are computed where vectors are scanned; only keys and distances are shuffled.  A global top-k is a
``TakeOrderedAndProject``: every task keeps k rows.  All orders end in a key, so that ties have one answer.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.functions.text import unique_strings
from lumenreel.functions.vectors import cosine_distance, is_vector, similarity

MODES = ("text", "image")
#: Most queries, and most rows, that meet in one task, and most distances that it holds at once.
QUERY_BLOCK = 4096
ROW_BLOCK = 65_536
PRODUCT = 4_000_000


def check_arguments(query: Sequence[float], mode: str, k: int, dimension: int | None = None) -> list[float]:
    """The query vector as unit-norm floats; errors for a bad mode, k, dimension, or a zero or infinite vector."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be an integer of at least 1")
    v = np.asarray(query, dtype=np.float64)
    if v.ndim != 1 or (dimension is not None and len(v) != dimension):
        raise ValueError(f"the query must be a vector of {dimension} numbers")
    if not np.isfinite(v).all() or not np.any(v):
        raise ValueError("the query must be finite and not zero")
    return (v / np.linalg.norm(v)).tolist()


def literal_vector(v: Sequence[float]) -> Column:
    return F.lit([float(x) for x in v]).cast("array<double>")


def with_distance(rows: DataFrame, vector: str, query: Sequence[float], name: str) -> DataFrame:
    """``rows`` whose vector has a distance to the query, with the vector replaced by it."""
    d = cosine_distance(F.col(vector), literal_vector(query))
    return rows.withColumn(name, d).filter(F.col(name).isNotNull()).drop(vector)


def best_keyframes(keyframes: DataFrame, distance: str) -> DataFrame:
    """The nearest keyframe of each segment, combined in every map task."""
    best = F.min_by(F.struct("*"), F.struct(distance, "keyframe_id"))
    return keyframes.groupBy("segment_id").agg(best.alias("best"))


def tag_filter(segments: DataFrame, region: str | None = None, all_tags: Sequence[str] = (), any_tags: Sequence[str] = ()) -> DataFrame:
    """Segments of a region that hold all of some tags and any of others; goes below the top-k."""
    if region is not None:
        segments = segments.filter(F.col("region") == region)
    for t in all_tags:
        segments = segments.filter(F.array_contains("tags", t))
    return segments.filter(F.arrays_overlap("tags", F.lit(list(any_tags)))) if any_tags else segments


# Where each of the 19 result columns comes from, in output order.
RESULT = (
    ("segment_id", "s"), ("keyframe_id", "k"), ("keyframe_path", "k"), ("place_id", "s"), ("region", "s"), ("spot_name", "s"), ("drama_title", "s"),
    ("description", "k"), ("time_of_day", "k"), ("mood", "k"), ("activity", "k"), ("scene_elements", "k"), ("video_id", "s"), ("start_time", "s"),
    ("end_time", "s"), ("text_score", "="), ("image_score", "="), ("similarity", "="), ("summary", "s"),
)


def search(segments: DataFrame, segment_vectors: DataFrame, keyframes: DataFrame, keyframe_vectors: DataFrame, query: Sequence[float], mode: str = "text", k: int = 5) -> DataFrame:
    """Top-k segments for one query vector, each with its keyframe nearest to the same vector.

    ``segment_vectors(segment_id, text_embedding)``, ``keyframe_vectors(keyframe_id, image_embedding)``.  Segments need a
    text vector and at least one keyframe vector in both modes.  Columns that a table lacks are null.  In text mode the k
    segments are found first, and keyframes of those alone are compared.
    """
    query = check_arguments(query, mode, k)
    text = with_distance(segment_vectors.select("segment_id", "text_embedding"), "text_embedding", query, "text_distance").join(segments, "segment_id")
    image = keyframes.join(with_distance(keyframe_vectors.select("keyframe_id", "image_embedding"), "image_embedding", query, "image_distance"), "keyframe_id")
    if mode == "text":
        top = text.join(image.select("segment_id"), "segment_id", "left_semi").orderBy("text_distance", "segment_id").limit(k)
        rows = top.join(best_keyframes(image.join(F.broadcast(top.select("segment_id")), "segment_id", "left_semi"), "image_distance"), "segment_id")
    else:
        rows = text.join(best_keyframes(image, "image_distance"), "segment_id").orderBy("best.image_distance", "segment_id").limit(k)
    own, frame = set(text.columns), set(image.columns)
    scores = {"text_score": similarity(F.col("text_distance")), "image_score": similarity(F.col("best.image_distance"))}
    scores["similarity"] = scores[f"{mode}_score"]

    def column(name: str, at: str) -> Column:
        if at == "=":
            return scores[name].alias(name)
        if at == "k" and name in frame:
            return F.col(f"best.{name}").alias(name)
        return F.col(name) if at == "s" and name in own else F.lit(None).cast("string").alias(name)

    return rows.select(*(column(*c) for c in RESULT)).orderBy(F.desc("similarity"), "segment_id")


def nearest(rows: DataFrame, vector: str, key: str, query: Sequence[float], k: int) -> DataFrame:
    """Top-k rows of one table by distance: the key, ``distance`` and ``similarity``."""
    query = check_arguments(query, "image", k)
    return with_distance(rows.select(key, vector), vector, query, "distance").orderBy("distance", key).limit(k).withColumn("similarity", similarity(F.col("distance")))


class Winners:
    """The k nearest rows of each query vector that a task has met so far; equal distances are ordered by key."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.worst = k, np.full(n, np.inf)
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n

    def add(self, d: np.ndarray, keys: np.ndarray) -> None:
        """Rows with ``keys`` and their distances ``d`` to all queries."""
        for q in np.flatnonzero((d <= self.worst[:, None]).any(axis=1)):
            row = d[q]
            limit = min(self.worst[q], np.partition(row, self.k - 1)[self.k - 1]) if len(row) > self.k else self.worst[q]
            some = np.flatnonzero(row <= limit)
            x, y = row[some], keys[some]
            if self.best[q] is not None:
                x, y = np.concatenate([self.best[q][0], x]), np.concatenate([self.best[q][1], y])
            top = np.lexsort((y, x))[: self.k]
            self.best[q] = x[top], y[top]
            if len(top) == self.k:
                self.worst[q] = x[top[-1]]

    def rows(self) -> tuple[np.ndarray, list, list]:
        """(number of the query, key, distance) of all winners."""
        full = [(i, *b) for i, b in enumerate(self.best) if b is not None]
        at = np.repeat(np.array([i for i, _, _ in full], np.int64), [len(x) for _, x, _ in full])
        return at, [v for _, _, y in full for v in y.tolist()], [v for _, x, _ in full for v in x.tolist()]


def matrix(column: pa.ChunkedArray, unit: bool = True) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix, to unit norm if so asked."""
    if not len(column):
        return np.zeros((0, 1))
    m = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True) if unit else m


def usable(df: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """Rows with a key and a vector of that many finite components, not all of them zero."""
    return df.filter(F.col(key).isNotNull() & is_vector(F.col(vector), dimension) & F.exists(vector, lambda x: x != 0))


def dimension_of(df: DataFrame, vector: str) -> int:
    first = df.filter(F.size(vector) > 0).select(F.size(vector)).first()
    return first[0] if first else 0


def ranked(found: DataFrame, key: str, k: int, by: str = "distance") -> DataFrame:
    """The first ``k`` rows of each query; only a task's own first ``k`` are shuffled."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(by, key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest_of_many(rows: DataFrame, queries: DataFrame, vector: str, key: str, k: int) -> DataFrame:
    """Top-k rows for each row of ``queries``: (query_id, key, distance, rank).

    Queries and rows are dealt into blocks of bounded size by hash, and each pair of blocks is one matrix product in one
    task, which keeps k rows a query; a window merges these winners.  The corpus is scanned once, each of its rows is
    shuffled once for each block of queries, and no vector reaches the driver.  Null, zero and not finite vectors, and
    those of another dimension than the first query's, neither ask nor answer.  Distances are rounded to 12 digits.
    """
    dimension = dimension_of(queries, vector)
    asks = -(-queries.count() // QUERY_BLOCK) or 1
    n = rows.count()
    answers = max(1, -(-n // ROW_BLOCK), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 1024))
    kind = rows.schema[key].dataType.simpleString()
    q = usable(queries, key, vector, dimension).select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    q = q.select("*", F.pmod(F.xxhash64("query_id", "v"), F.lit(asks)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(answers - 1)).cast("array<long>")).alias("b"))
    r = usable(rows, key, vector, dimension).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    r = r.select("*", F.pmod(F.xxhash64("key", "v"), F.lit(answers)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1)).cast("array<long>")).alias("a"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        won = Winners(left.num_rows, k)
        m, step = matrix(left.column("v")), max(1, PRODUCT // max(1, left.num_rows))
        for i in range(0, right.num_rows if left.num_rows else 0, step):
            part = right.slice(i, step)
            won.add(np.round(1 - m @ matrix(part.column("v")).T, 12), part.column("key").to_numpy())
        at, keys, distance = won.rows()
        return pa.table({"query_id": left.column("query_id").take(pa.array(at)), key: pa.array(keys, right.schema.field("key").type), "distance": pa.array(distance, pa.float64())})

    found = q.groupBy("a", "b").cogroup(r.groupBy("a", "b")).applyInArrow(cell, f"query_id {kind}, `{key}` {kind}, distance double")
    return ranked(found, key, k)


def tags_of(scene: Column, activity: Column) -> Column:
    return unique_strings(F.concat(F.coalesce(scene, F.array().cast("array<string>")), F.coalesce(activity, F.array().cast("array<string>"))))
