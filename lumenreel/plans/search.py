"""Vector searches over ``embeddings``: a label is a segment, a vector a keyframe, the lowest vector of a label its text vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.functions import vectors as V
from lumenreel.functions.scores import rounded
from lumenreel.operators import index
from lumenreel.operators import search as S
from lumenreel.operators import segments as G
from lumenreel.operators import tables as T
from lumenreel.operators.encoders import Encoder
from lumenreel.plans import query
from lumenreel.plans.common import SERIES, series, table
from lumenreel.sources.io import scratch


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[float]]:
    e = table(spark, sf_dir, "embeddings")
    text = e.groupBy(F.col("label").alias("segment_id")).agg(F.min_by("embedding", "vec_id").alias("text_embedding"))
    segments = e.select(F.col("label").alias("segment_id")).distinct().withColumns({"region": F.concat(F.lit("r"), F.col("segment_id") % 3), "tags": F.array(F.concat(F.lit("t"), F.col("segment_id") % 2), F.concat(F.lit("u"), F.col("segment_id") % 5))})
    frames = e.select(F.col("vec_id").alias("keyframe_id"), F.col("label").alias("segment_id"))
    vectors = e.select(F.col("vec_id").alias("keyframe_id"), F.col("embedding").alias("image_embedding"))
    q = e.filter("vec_id = 0").select("embedding").first()[0]
    return segments, text, frames, vectors, q


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("segment_id", "keyframe_id", *(F.round(c, 6).alias(c) for c in ("text_score", "image_score", "similarity")))


_D = """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], q.v) AS dist FROM embeddings, q),
t AS (SELECT label, arg_min(dist, vec_id) AS td FROM d GROUP BY label),
k AS (SELECT label, vec_id, dist, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rn FROM d)
"""
_ROW = "SELECT t.label AS segment_id, k.vec_id AS keyframe_id, round(1 - td, 6) AS text_score, round(1 - dist, 6) AS image_score, round(1 - {x}, 6) AS similarity FROM t JOIN k USING (label) WHERE rn = 1 {w} ORDER BY {x}, t.label LIMIT 5"


@query("search_image", _D + _ROW.format(x="dist", w=""))
def search_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, text, frames, vectors, q = _tables(spark, sf_dir)
    return _shown(S.search(segments, text, frames, vectors, q, "image", 5))


@query("search_text", _D + _ROW.format(x="td", w=""))
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, text, frames, vectors, q = _tables(spark, sf_dir)
    return _shown(S.search(segments, text, frames, vectors, q, "text", 5))


@query("search_filtered", _D + _ROW.format(x="td", w="AND t.label % 3 = 1 AND (t.label % 2 = 0 OR t.label % 5 = 2)"))
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, text, frames, vectors, q = _tables(spark, sf_dir)
    return _shown(S.search(S.tag_filter(segments, region="r1", any_tags=["t0", "u2"]), text, frames, vectors, q, "text", 5))


@query("nearest_vectors", "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS distance, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS similarity FROM embeddings, q ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q.v), vec_id LIMIT 10")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = S.nearest(e, "embedding", "vec_id", e.filter("vec_id = 0").first()["embedding"], 10)
    return rows.select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query("nearest_of_many", "WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 5")
def nearest_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = S.nearest_of_many(e, e.filter("vec_id % 50 = 0"), "embedding", "vec_id", 5)
    return rows.select("query_id", "vec_id", F.abs(F.round("distance", 6)).alias("distance"), "rank")


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """All embeddings, and an index of them: those of one half of the labels are there when it is fitted, the others are inserted."""
    e, folder = table(spark, sf_dir, "embeddings"), scratch(spark)
    first = F.col("label") % 2 == 0
    index.build(e.filter(first), "embedding", "vec_id", folder)
    index.insert(e.filter(~first), "embedding", "vec_id", folder)
    return e, folder


@query("nearest_approximate")
def nearest_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, folder = table(spark, sf_dir, "embeddings"), scratch(spark)
    index.build(e, "embedding", "vec_id", folder)
    rows = index.search(folder, e.filter("vec_id % 50 = 0"), "embedding", "vec_id", 10)
    return rows.select("query_id", "vec_id", F.abs(F.round("distance", 6)).alias("distance"), "rank")


@query("approximate_recall", "SELECT count(*) AS n_queries, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0")
def approximate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether nearest_approximate finds nine tenths of the ten true neighbours of all its queries."""
    asks = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0")
    exact = S.nearest_of_many(table(spark, sf_dir, "embeddings"), asks, "embedding", "vec_id", 10).select("query_id", "vec_id", F.lit(1).alias("_true"))
    found = nearest_approximate(spark, sf_dir).select("query_id", "vec_id", F.lit(1).alias("_found"))
    both = exact.join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"), (F.count("_found") >= 0.9 * F.count("_true")).alias("recall_reached"))


@query("nearest_indexed", "WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 3")
def nearest_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact through the index: bounds of the codes' errors leave out rows that cannot be among the first three."""
    e, folder = _indexed(spark, sf_dir)
    rows = index.exact_search(folder, e.filter("vec_id % 50 = 0"), "embedding", "vec_id", 3)
    return rows.select("query_id", "vec_id", F.abs(F.round("distance", 6)).alias("distance"), "rank")


@query("vector_validation", "SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64) AS valid, count(*) FILTER (len(list_transform(embedding, lambda x: x)) <> 64 OR vec_id % 10 = 3) AS broken FROM embeddings GROUP BY label")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    nan = F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))
    bad = F.when(F.col("vec_id") % 10 == 3, nan).otherwise(F.col("embedding"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(V.is_vector(F.col("embedding"), 64)).alias("valid"), F.count_if(~V.is_vector(bad, 64)).alias("broken"))


@query("vector_normalised", "SELECT vec_id, 3 * embedding[1]::DOUBLE / greatest(1e-12, sqrt(list_reduce(list_transform(embedding::DOUBLE[], lambda x: (3 * x) * (3 * x)), lambda s, x: s + x))) AS first, 1.0 AS length FROM embeddings")
def vector_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.normalised(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("u"))
    return e.select("vec_id", F.get("u", F.lit(0)).alias("first"), F.round(V.norm(F.col("u")), 6).alias("length"))


def histograms(spark: SparkSession, sf_dir: str, by_day: bool = False) -> DataFrame:
    """(video_id[, day], histogram): counts of a user's values in 24 bins."""
    keys = ["video_id", "day"] if by_day else ["video_id"]
    e = series(spark, sf_dir).select("video_id", F.floor(F.col("t") / 86_400).cast("int").alias("day"), F.least(F.floor(F.col("value") / 20.5), F.lit(23)).cast("int").alias("bin"))
    bins = e.groupBy(*keys, "bin").agg(F.count("*").cast("double").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return bins.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("histogram"))


HISTOGRAMS = "b AS (SELECT user_id AS video_id, least(floor(value / 20.5), 23)::INT AS bin, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), g AS (SELECT DISTINCT video_id, unnest(range(24)) AS bin FROM b), hist AS (SELECT video_id, list(coalesce(n, 0.0) ORDER BY bin) AS histogram FROM g LEFT JOIN b USING (video_id, bin) GROUP BY 1)"
DAY_HISTOGRAMS = f"{SERIES}, db AS (SELECT video_id, floor(t / 86400)::INT AS day, least(floor(value / 20.5), 23)::INT AS bin, count(*)::DOUBLE AS n FROM s GROUP BY ALL), dg AS (SELECT DISTINCT video_id, day, unnest(range(24)) AS bin FROM db), dh AS (SELECT video_id, day, list(coalesce(n, 0.0) ORDER BY bin) AS histogram FROM dg LEFT JOIN db USING (video_id, day, bin) GROUP BY ALL)"


@query("histogram_correlation", f"WITH {HISTOGRAMS}, p AS (SELECT a.video_id, unnest(a.histogram) AS x, unnest(b.histogram) AS y FROM hist a JOIN hist b ON b.video_id = a.video_id + 1) SELECT video_id, round(coalesce(corr(x, y), 0), 6) AS correlation, round(sqrt(greatest(0, 1 - sum(sqrt(x * y)) / sqrt(sum(x) * sum(y)))), 6) AS distance FROM p GROUP BY video_id")
def histogram_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = histograms(spark, sf_dir)
    rows = h.join(h.select((F.col("video_id") - 1).alias("video_id"), F.col("histogram").alias("next")), "video_id")
    return rows.select("video_id", F.round(V.correlation(F.col("histogram"), F.col("next")), 6).alias("correlation"), F.round(V.bhattacharyya(F.col("histogram"), F.col("next")), 6).alias("distance"))


def hashing_encoder(texts: pd.Series) -> list[np.ndarray]:
    """A stand-in for a model: token hashes spread over 16 dimensions."""
    import zlib

    out = []
    for t in texts:
        v = np.zeros(16, np.float32)
        for w in (t or "").split():
            h = zlib.crc32(w.encode())
            v[h % 16] += 1 if h & 16 else -1
        out.append(v / max(1e-12, float(np.linalg.norm(v))))
    return out


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    seg = F.concat(F.lit("C"), "conv_id")
    return c.select(seg.alias("segment_id"), seg.alias("video_id"), "role", "text", F.col("turn").alias("item_idx"), F.concat(F.lit("keyframes/"), "conv_id", F.lit("/"), "turn", F.lit(".jpg")).alias("keyframe_path"), F.lit("drama").alias("drama_title"))


def byte_profile(items: list) -> list[np.ndarray]:
    """A stand-in for a model, which SQL can repeat: how often each of the letters a to h occurs, to unit length."""
    counts = [np.array([(x or "").count(c) for c in "abcdefgh"], np.float64) for x in items]
    return [v / max(1e-12, float(np.sqrt(v @ v))) for v in counts]


#: The model by name: each Python worker loads it once.
PROFILE = Encoder("byte_profile", lambda: byte_profile, 8, most=64, cost=20_000, double=True)
_PROFILE = "list_transform(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'], lambda c: (length(x) - length(replace(x, c, '')))::DOUBLE)"


@query("encoded_texts", f"WITH p AS (SELECT conv_id, turn, {_PROFILE} AS v FROM (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations)), n AS (SELECT conv_id, turn, unnest(v) AS c, unnest(range(8)) AS i, greatest(1e-12, sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS norm FROM p) SELECT conv_id, turn, i::INT AS i, round(c / norm, 5) AS value FROM n WHERE c > 0")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of all turns' vectors, from an encoder that is loaded once a worker and fed by cost."""
    rows = G.encoded(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", PROFILE, 8, "v")
    return rows.select("conv_id", "turn", F.posexplode("v").alias("i", "value")).filter("value > 0").withColumn("value", rounded(F.col("value"), 5))


@query("embedding_records", "SELECT 'C' || conv_id AS segment_id, count(DISTINCT turn) AS keyframes, 16 AS dimension, true AS unit FROM conversations GROUP BY conv_id")
def embedding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, frames = G.embedding_records(_items(spark, sf_dir), {"spot_name": "role", "description": "text"}, hashing_encoder, hashing_encoder, 16)
    frames = frames.groupBy("segment_id").agg(F.count("*").alias("keyframes"))
    length = F.round(V.norm(F.col("text_embedding")), 5)
    return segments.join(frames, "segment_id").select("segment_id", "keyframes", F.size("text_embedding").alias("dimension"), (length == 1).alias("unit"))


@query("prepared_records", "SELECT 'C' || conv_id AS segment_id, count(*) AS keyframes, arg_min(role, turn) AS role, 'C' || conv_id || '__' || min(turn) AS first_keyframe FROM conversations GROUP BY conv_id")
def prepared_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    one = F.array(F.lit(1.0).cast("float"))
    segments = items.select("segment_id").distinct().withColumn("text_embedding", one)
    frames = items.select("segment_id", "keyframe_path").distinct().withColumn("image_embedding", one)
    s, k = G.prepared_records(items, segments, frames, 1)
    k = k.groupBy("segment_id").agg(F.count("*").alias("keyframes"), F.min_by("keyframe_id", "item_idx").alias("first_keyframe"))
    return s.select("segment_id", "role").join(k, "segment_id")


@query("segment_texts", r"WITH i AS (SELECT conv_id, turn, concat_ws('. ', CASE WHEN trim(role) <> '' AND lower(trim(role)) <> 'unknown' THEN trim(role) END, CASE WHEN trim(text, E' \n\t') <> '' AND lower(trim(text, E' \n\t')) <> 'unknown' THEN trim(text, E' \n\t') END, 'Mood: ' || trim(role) || ', m' || (turn % 3)) AS x FROM conversations), f AS (SELECT conv_id, x, min(turn) AS first_turn, count(*) AS c FROM (SELECT conv_id, turn, first_value(x) OVER (PARTITION BY conv_id, lower(x) ORDER BY turn) AS x, lower(x) AS l FROM i) GROUP BY conv_id, x) SELECT 'C' || conv_id AS segment_id, string_agg(x, '. ' ORDER BY first_turn) AS search_text, sum(c)::BIGINT AS n_items FROM f GROUP BY conv_id")
def segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumn("mood", F.array("role", F.concat(F.lit("m"), F.col("item_idx") % 3), F.upper("role"), F.lit(" Unknown ")))
    return G.segment_texts(items, {"spot_name": "role", "description": "text", "mood": "mood"}).select("segment_id", "search_text", F.col("n_items").cast("long").alias("n_items"))


@query("video_rows", "SELECT 'C' || conv_id AS video_id, 'C' || conv_id || ' 관광 영상' AS title, 'C' || conv_id || '의 VLM 기반 관광 영상' AS description, NULL::VARCHAR AS video_path, 'ko' AS language FROM conversations GROUP BY conv_id")
def video_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.video_rows(_items(spark, sf_dir))


@query("grouped_items", "SELECT conv_id AS segment_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def grouped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "segment_id")
    g = T.grouped_items(c, "segment_id", "turn", ["role"]).select("segment_id", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x["role"]), ",").alias("roles"))
    first = T.first_of(c, "segment_id", "turn", ["role"]).withColumnRenamed("role", "first_role")
    return g.join(first, "segment_id").join(T.last_of(c, "segment_id", "turn", ["role"]).withColumnRenamed("role", "last_role"), "segment_id")
