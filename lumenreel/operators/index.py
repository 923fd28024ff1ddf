"""An approximate search index on disk, of which a search reads a part.

The index is one Parquet table, laid out by *list* (``partitionBy``): every vector is in the list of its nearest centre, and
has a short *code*, the product quantisation of what is left of it after the centre.  Lists grow in number with the square
root of the rows.  A search

1. picks each query's nearest lists, of which only keys and codes are read (partition pruning, two columns of three);
2. decodes them block by block, one matrix product for a block of a list and the queries that look there, and keeps each
   query's best candidates;
3. reads the vectors of the lists that hold a candidate, and ranks candidates by exact distances.

Centres and codebooks are fitted on a bounded sample; every row is indexed.  How many lists a query looks at is measured on
the sample when the index is built: as many as hold ``coverage`` of its queries' true neighbours there.  ``insert`` adds rows
to the lists that are there.  Each row is stored with its code's error, by which ``exact_search`` misses nothing.  A list
with a large share of all rows is written and searched in shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.functions.vectors import cosine_distance, normalised
from lumenreel.operators import search as S
from lumenreel.sources.folders import kept

#: Centres are sent to all tasks: at most so many.
MOST_LISTS = 1 << 16
#: Rows of the sample from which codebooks and the number of probes come, on the driver.
CODEBOOK_SAMPLE = 20_000


@dataclass
class Model:
    """Unit ``centres`` (lists, d), ``codebooks`` (parts, entries, d / parts), and the default number of lists to look at."""

    centres: np.ndarray
    codebooks: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The ``n`` nearest lists of each row."""
        d = -(x @ self.centres.T)
        some = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable"), axis=1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = (x - self.centres[lists]).reshape(len(x), self.codebooks.shape[0], -1)
        return np.stack([_closest(rest[:, p], book) for p, book in enumerate(self.codebooks)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, lists: int | np.ndarray) -> np.ndarray:
        parts = self.codebooks.shape[0]
        return self.centres[lists] + self.codebooks[np.arange(parts), codes].reshape(len(codes), -1)


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def _codebook(x: np.ndarray, entries: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds on a bounded sample; an entry that nothing is nearest to stays where it is."""
    book = x[rng.choice(len(x), entries, replace=len(x) < entries)].copy()
    for _ in range(rounds):
        at = _closest(x, book)
        n = np.bincount(at, minlength=entries)
        sums = np.stack([np.bincount(at, weights=x[:, i], minlength=entries) for i in range(x.shape[1])], axis=1)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def _probes(x: np.ndarray, model: Model, coverage: float, k: int = 10, queries: int = 256) -> int:
    """Lists to look at so that ``coverage`` of the ``k`` nearest sample rows of some sample rows are in them."""
    q = x[:queries]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, : k + 1]
    place = np.argsort(np.argsort(-(q @ model.centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.sort(np.take_along_axis(place, model.nearest(x)[near, 0], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(coverage * len(ranks))))]) + 1 if len(ranks) else 1


def build(rows: DataFrame, vector: str, key: str, folder: str, lists: int | None = None, parts: int | None = None, sample: int = 100_000, coverage: float = 0.95, seed: int = 7) -> Model:
    """Fit an index on about ``sample`` rows of ``rows(key, vector)`` and write all usable rows to ``folder``.

    ``parts``: bytes a code, by default one for two components.  ``lists``: by default the square root of the rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    dimension = S.dimension_of(rows, vector)
    good = S.usable(rows, key, vector, dimension)
    n = good.count()
    if not n:
        raise ValueError("there is no vector to index")
    lists = min(lists or isqrt(n), MOST_LISTS, max(1, min(n, sample) // 4))
    parts = parts or next(p for p in range(max(1, dimension // 2), 0, -1) if dimension % p == 0)
    place = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30))
    some = good.filter(place <= F.lit(int(min(1.0, sample / n) * (1 << 30)))).select(normalised(F.col(vector)).alias("u"), place.alias("h"))
    fitted = KMeans(featuresCol="x", k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(some.select(array_to_vector("u").alias("x"))) if lists > 1 else None
    few = min(1.0, CODEBOOK_SAMPLE / min(n, sample)) * min(1.0, sample / n)
    x = S.matrix(some.filter(F.col("h") <= F.lit(int(few * (1 << 30)))).orderBy("h").limit(2 * CODEBOOK_SAMPLE).toArrow().column("u"))
    centres = np.stack(fitted.clusterCenters()) if fitted else x.mean(axis=0, keepdims=True)
    centres = centres / np.maximum(1e-12, np.linalg.norm(centres, axis=1, keepdims=True))
    model = Model(centres, np.zeros((parts, 1, dimension // parts)), 1)
    rest = (x - centres[model.nearest(x)[:, 0]]).reshape(len(x), parts, -1)
    rng = np.random.default_rng(seed)
    model.codebooks = np.stack([_codebook(rest[:, p], min(256, max(1, len(x) // 4)), rng) for p in range(parts)])
    model.probes = _probes(x, model, coverage)
    spark = rows.sparkSession
    told = [("centre", i, c.tolist()) for i, c in enumerate(centres)] + [("book", p, b.ravel().tolist()) for p, b in enumerate(model.codebooks)] + [("probes", model.probes, None)]
    spark.createDataFrame(told, "kind string, i int, v array<double>").coalesce(1).write.parquet(f"{folder}/model")
    _write(good, vector, key, folder, model)
    return model


def load(spark: SparkSession, folder: str) -> Model:
    rows = spark.read.schema("kind string, i int, v array<double>").parquet(f"{folder}/model").orderBy("i").collect()  # at most MOST_LISTS centres
    centres = np.array([r.v for r in rows if r.kind == "centre"])
    books = [np.array(r.v) for r in rows if r.kind == "book"]
    return Model(centres, np.stack([b.reshape(-1, centres.shape[1] // len(books)) for b in books]), next(r.i for r in rows if r.kind == "probes"))


def _write(good: DataFrame, vector: str, key: str, folder: str, model: Model) -> None:
    sent = good.sparkSession.sparkContext.broadcast(model)
    kind = {c: good.schema[c].dataType.simpleString() for c in (key, vector)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            if b.num_rows:
                x = S.matrix(pa.chunked_array([b.column(1)]))
                at = np.concatenate([m.nearest(x[i : i + 1024])[:, 0] for i in range(0, len(x), 1024)])
                codes = m.encode(x, at)
                error = np.concatenate([np.linalg.norm(x[i : i + 1024] - m.decode(codes[i : i + 1024], at[i : i + 1024]), axis=1) for i in range(0, len(x), 1024)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), b.column(1), pa.array(at.astype(np.int32))], ["key", "code", "error", "vector", "list"])

    coded = good.select(key, vector).mapInArrow(run, f"key {kind[key]}, code binary, error double, vector {kind[vector]}, list int")
    # A list's rows come together in few files; lists beyond a task's fair share are split.
    coded.hint("rebalance", "list").sortWithinPartitions("list", "key").write.mode("append").partitionBy("list").parquet(f"{folder}/rows")


def insert(rows: DataFrame, vector: str, key: str, folder: str) -> None:
    """Add rows to an index, into the lists that it has.  Keys that are there already get a second row."""
    model = load(rows.sparkSession, folder)
    _write(S.usable(rows, key, vector, model.centres.shape[1]), vector, key, folder, model)


def _rows(spark: SparkSession, folder: str, key_kind: str, vector_kind: str) -> DataFrame:
    return spark.read.schema(f"key {key_kind}, code binary, error double, vector {vector_kind}, list int").parquet(f"{folder}/rows")


def _dealt(stored: DataFrame, queries: DataFrame, model: Broadcast, probes: int, *columns: str) -> tuple[Any, dict[str, str]]:
    """Blocks of ``queries(query_id, v, ...)`` with blocks of the lists that they look at, and the types of both keys."""
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "key": stored.schema["key"].dataType.simpleString()}
    asked = ", ".join(f"{c} {kind}" for c, kind in queries.dtypes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                near = model.value.nearest(S.matrix(pa.chunked_array([part.column("v")])), probes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], [*part.schema.names, "lists"])

    asks = -(-queries.count() // S.QUERY_BLOCK) or 1
    lists = len(model.value.centres)
    looked = queries.mapInArrow(look, f"{asked}, lists array<int>")
    looked = looked.select(*queries.columns, F.explode("lists").alias("list"), F.pmod(F.xxhash64("query_id", "v"), F.lit(asks)).alias("a"))
    if probes < lists:
        wanted = [r.list for r in looked.select("list").distinct().collect()]  # at most MOST_LISTS numbers
        stored = stored.filter(F.col("list").isin(wanted)) if len(wanted) < lists else stored
    sizes = stored.groupBy("list").count().filter(F.col("count") > S.ROW_BLOCK).collect()  # the long lists only
    shards = F.lit(1)
    for r in sizes:
        shards = F.when(F.col("list") == r.list, -(-r["count"] // S.ROW_BLOCK)).otherwise(shards)
    left = looked.withColumn("b", F.explode(F.sequence(F.lit(0), shards - 1).cast("array<long>")))
    right = stored.select("key", "list", *columns, F.pmod(F.xxhash64("key"), shards).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1)).cast("array<long>")).alias("a"))
    return left.groupBy("list", "a", "b").cogroup(right.groupBy("list", "a", "b")), kinds


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def candidates(stored: DataFrame, queries: DataFrame, model: Model, probes: int, most: int) -> DataFrame:
    """(query_id, key, list, distance): about the ``most`` nearest coded rows in the ``probes`` nearest lists of each query.

    ``queries(query_id, v)``; distances are those of the decoded vectors.
    """
    sent = queries.sparkSession.sparkContext.broadcast(model)
    cells, kinds = _dealt(stored, queries, sent, probes, "code")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        won, m = S.Winners(left.num_rows, most), sent.value
        one = right.column("list")[0].as_py() if right.num_rows else 0
        if left.num_rows and right.num_rows:
            q, step = S.matrix(left.column("v")), max(1, S.PRODUCT // left.num_rows)
            codes = _codes(right.column("code"))
            keys = right.column("key").to_numpy()
            for i in range(0, len(codes), step):
                won.add(1 - q @ m.decode(codes[i : i + step], one).T, keys[i : i + step])
        at, keys, distance = won.rows()
        return pa.table({"query_id": left.column("query_id").take(pa.array(at)), "key": pa.array(keys, right.schema.field("key").type), "list": pa.array([one] * len(keys), pa.int32()), "distance": pa.array(distance, pa.float64())})

    found = cells.applyInArrow(cell, f"query_id {kinds['query_id']}, key {kinds['key']}, list int, distance double")
    return S.ranked(found, "key", most)


def search(folder: str, queries: DataFrame, vector: str, key: str, k: int, probes: int | None = None, most: int | None = None, vector_kind: str | None = None) -> DataFrame:
    """Top-k rows for each row of ``queries(key, vector)``: (query_id, key, distance, rank), as nearest_of_many.

    ``probes``: lists a query looks at; ``most``: candidates whose exact distance is taken, by default three times ``k``.
    """
    spark, model = queries.sparkSession, load(queries.sparkSession, folder)
    kind = queries.schema[key].dataType.simpleString()
    stored = _rows(spark, folder, kind, vector_kind or queries.schema[vector].dataType.simpleString())
    asks = S.usable(queries, key, vector, model.centres.shape[1]).select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    # Candidates are read twice: which lists hold them, and for the exact distances.
    found = kept(candidates(stored, asks, model, min(probes or model.probes, len(model.centres)), most or 3 * k).select("query_id", "key", "list"))
    lists = [r.list for r in found.select("list").distinct().collect()]
    rows = stored.filter(F.col("list").isin(lists)).select("list", "key", "vector") if len(lists) < len(model.centres) else stored.select("list", "key", "vector")
    exact = rows.join(found.distinct(), ["list", "key"]).join(asks, "query_id")
    exact = exact.select("query_id", F.col("key").alias(key), F.round(cosine_distance(F.col("v"), F.col("vector")), 12).alias("distance"))
    return S.ranked(exact.filter("distance is not null"), key, k)


def exact_search(folder: str, queries: DataFrame, vector: str, key: str, k: int, vector_kind: str | None = None) -> DataFrame:
    """Top-k rows as ``search`` returns them, without a miss.

    A search as usual tells how far a query's ``k`` nearest rows are at most.  Then all codes are read: the true distance is
    off that of the decoded vector by no more than the length of what the code lost, so a row whose distance less its
    error is above the limit is out, and the vectors of the others decide.  A task keeps ``k`` rows a query.
    """
    spark, model = queries.sparkSession, load(queries.sparkSession, folder)
    kind = queries.schema[key].dataType.simpleString()
    stored = _rows(spark, folder, kind, vector_kind or queries.schema[vector].dataType.simpleString())
    asks = S.usable(queries, key, vector, model.centres.shape[1]).select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    near = search(folder, queries, vector, key, k, vector_kind=vector_kind).filter(F.col("rank") == k).groupBy("query_id").agg(F.max("distance").alias("limit"))
    asks = kept(asks.join(near, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(3.0))))
    sent = spark.sparkContext.broadcast(model)
    cells, kinds = _dealt(stored, asks, sent, len(model.centres), "code", "error", "vector")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        won, m = S.Winners(left.num_rows, k), sent.value
        if left.num_rows and right.num_rows:
            q, step = S.matrix(left.column("v")), max(1, S.PRODUCT // left.num_rows)
            limit, one = left.column("limit").to_numpy()[:, None] + 1e-9, right.column("list")[0].as_py()
            for i in range(0, right.num_rows, step):
                part = right.slice(i, step)
                open_ = 1 - q @ m.decode(_codes(part.column("code")), one).T - part.column("error").to_numpy() <= limit
                at = np.flatnonzero(open_.any(axis=0))
                if len(at):
                    part = part.take(pa.array(at))
                    d = np.round(1 - q @ S.matrix(part.column("vector")).T, 12)
                    won.add(np.where(open_[:, at], d, np.inf), part.column("key").to_numpy())
        at, keys, distance = won.rows()
        rows = pa.table({"query_id": left.column("query_id").take(pa.array(at)), key: pa.array(keys, right.schema.field("key").type), "distance": pa.array(distance, pa.float64())})
        return rows.filter(pc.is_finite(rows.column("distance")))

    found = cells.applyInArrow(cell, f"query_id {kinds['query_id']}, `{key}` {kinds['key']}, distance double")
    return S.ranked(found, key, k)
