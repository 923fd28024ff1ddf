"""Sources, sinks, the keyed store and streams: each query derives files from the tables, and reads them again."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.operators import tagging
from lumenreel.operators.scenes import REPORT
from lumenreel.plans import query
from lumenreel.plans.common import table
from lumenreel.plans.series import quality_report
from lumenreel.sources import io, store
from lumenreel.sources.folders import kept
from lumenreel.sources.io import scratch
from lumenreel.streaming import incremental, records


def _array_files(spark: SparkSession, sf_dir: str, *columns: Column, mark: str = "") -> str:
    """A folder of JSON array files with the turns of ten conversations each."""
    folder = scratch(spark)
    c = table(spark, sf_dir, "conversations")
    body = F.array_sort(F.collect_list(F.struct("conv_id", "turn", F.struct(*columns).alias("item"))))
    files = c.groupBy(F.floor(F.col("conv_id") / 10).alias("file")).agg(F.concat(F.lit(mark), F.to_json(F.transform(body, lambda x: x["item"]))).alias("value"))
    files.write.partitionBy("file").text(folder)
    return folder


@query("metadata_scan", "SELECT conv_id || '-' || turn AS segment_id, role AS region, turn::DOUBLE AS start_time, 2 AS moods, length(coalesce(text, '')) AS chars FROM conversations")
def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("-", "conv_id", "turn").alias("segment_id")
    folder = _array_files(spark, sf_dir, key, F.col("role").alias("region"), F.col("turn").cast("double").alias("start_time"), F.array(F.lit("a"), "role").alias("mood"), F.col("text").alias("description"), mark="\ufeff")
    return io.read_metadata(spark, folder).select("segment_id", "region", "start_time", F.size("mood").alias("moods"), F.coalesce(F.length("description"), F.lit(0)).cast("long").alias("chars"))


@query("metadata_items", "SELECT (row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn) - 1)::INT AS item_idx, conv_id, turn, role FROM conversations")
def metadata_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = io.read_items(spark, _array_files(spark, sf_dir, F.col("conv_id"), F.col("turn"), F.col("role")))
    return rows.select("item_idx", *(F.try_variant_get("item", f"$.{n}", t).alias(n) for n, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"))))


@query("report_files", "SELECT o_custkey::VARCHAR AS video_id, bool_or(o_totalprice > 100000) AS accepted, count(*) AS rows FROM orders GROUP BY 1")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of several runs, one of which has none yet."""
    root = scratch(spark)
    o = table(spark, sf_dir, "orders")
    for n, half in enumerate((F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 2 == 1)):
        rows = o.filter(half).select(F.col("o_custkey").cast("string").alias("video_id"), F.col("o_totalprice").alias("candidate_start"), (F.col("o_totalprice") > 100_000).alias("accepted"))
        io.write_report(rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in REPORT)), f"{root}/run{n}")
    rows = io.read_report(spark, f"{root}/run0").union(io.read_report(spark, f"{root}/run1")).union(io.read_report(spark, f"{root}/run2"))
    return rows.groupBy("video_id").agg(F.bool_or("accepted").alias("accepted"), F.count("*").alias("rows"))


@query("report_roundtrip", "SELECT o_custkey::VARCHAR AS video_id, count(*) AS rows, round(sum(o_totalprice), 2) AS starts FROM orders GROUP BY 1")
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    rows = quality_report(spark, sf_dir)
    io.write_report(rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in REPORT)), folder)
    return io.read_report(spark, folder).groupBy("video_id").agg(F.count("*").alias("rows"), F.round(F.sum("candidate_start"), 2).alias("starts"))


@query("json_roundtrip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    io.write_json(s, folder)
    return spark.read.schema(s.schema).json(folder)


@query("output_files", "SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def output_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, names = scratch(spark), ("customer", "supplier")
    io.write_outputs({n: table(spark, sf_dir, n) for n in names}, folder)
    a, b = (spark.read.parquet(f"{folder}/{n}").agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names)
    return a.union(b)


@query("asset_listing", "SELECT 'o_orderstatus=' || o_orderstatus AS folder, 1 AS found FROM orders GROUP BY o_orderstatus")
def asset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").repartition(3, "o_orderstatus").write.partitionBy("o_orderstatus").parquet(folder)
    files = io.list_assets(spark, folder, "*.parquet")
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.lit(1).alias("found"))


@query("catalog_scan", "SELECT n_name AS drama_title, s_suppkey::VARCHAR AS segment_id, 'unknown' AS place_name, 0.0 AS end_time, s_acctbal AS start_time FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    segment = F.struct(F.col("s_suppkey").cast("string").alias("segment_id"), F.col("s_acctbal").alias("start_time"), none("double", "end_time"), none("string", "description"))
    place = F.struct(F.concat(F.lit("P"), "n_nationkey").alias("place_id"), none("string", "place_name"), none("string", "region"), none("string", "youtube_id"), F.collect_list(segment).alias("segments"))
    catalog = s.groupBy("n_name", "n_nationkey").agg(place.alias("p")).select(F.col("n_name").alias("video_id_prefix"), F.col("n_name").alias("drama_title"), F.array("p").alias("places"))
    return tagging.flattened(catalog).select("drama_title", "segment_id", "place_name", "end_time", "start_time")


@query("source_config", "SELECT n_name AS drama_title, s_suppkey::VARCHAR AS video_id, s_suppkey % 3 = 0 AS config_error FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def source_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    source = F.struct(F.col("s_suppkey").cast("string").alias("video_id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).otherwise("  ").alias("filename"))
    groups = s.groupBy(F.col("n_name").alias("drama_title")).agg(F.first("n_regionkey").cast("string").alias("region"), F.collect_list(source).alias("sources"))
    return tagging.flattened_sources(groups).select("drama_title", "video_id", "config_error")


@query("tagged_catalog", """WITH s AS (SELECT *, regexp_extract(s_name, '[0-9]+') AS place, s_suppkey % 2 = 1 AND s_suppkey % 8 <> 5 AS ok FROM supplier)
SELECT s_suppkey AS segment_id, ok AS tags_ok, CASE WHEN ok THEN 'bright' ELSE 'calm' END AS mood, CASE WHEN ok AND s_suppkey % 4 = 1 THEN '강' ELSE place END AS scene_elements, coalesce(x, 'no captions') AS script, CASE WHEN ok THEN '강가' ELSE s_name || ' 관련 드라마 촬영 장면입니다.' END AS description
FROM s LEFT JOIN (SELECT user_id, string_agg(event_type, ' ' ORDER BY value, event_type) AS x FROM events WHERE value <= 9 GROUP BY 1) ON user_id = s_suppkey""")
def tagged_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as segments with the captions of the user of the same number; some have no reply, some one outside the vocabulary."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("segment_id"), F.col("s_suppkey").cast("string").alias("youtube_id"), F.lit(0.0).alias("start"), F.lit(9.0).alias("end"), F.lit("d").alias("drama_title"), F.col("s_name").alias("place_name"), F.lit("r").alias("region"))
    captions = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("youtube_id"), F.col("value").alias("start"), F.lit(1.0).alias("duration"), F.col("event_type").alias("text"))

    def annotate(title: str, place: str, region: str, script: str) -> str:
        n = int(place.split("#")[-1])
        if n % 2 == 0:
            raise RuntimeError("no answer")
        seen = ["강", "자막"] if n % 4 == 1 else ["자막"]
        return json.dumps({"mood": ["nonsense" if n % 8 == 5 else "bright"], "scene_elements": seen, "description": "이 영상은 강가"})

    out = tagging.tagged_catalog(rows, captions, annotate, {"mood": ["bright", "calm"]}, {"mood": ["calm"]}, ["자막"], ["이 영상은"])
    return out.select("segment_id", "tags_ok", F.array_join("mood", "|").alias("mood"), F.array_join("scene_elements", "|").alias("scene_elements"), "script", "description")


_SPOTS = ("spot_name", "region", "address", "latitude", "longitude", "description", "source_url")


def _store_tables(spark: SparkSession, sf_dir: str, keep: str, word: str) -> dict[str, DataFrame]:
    """The six tables of one load: all values that are not keys say which load they come from."""
    o = table(spark, sf_dir, "orders").filter(keep)
    key, video, place = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.concat(F.lit("P"), F.col("o_custkey") % 7)
    said, listed, stamp = (lambda n: F.lit(f"{n} {word}").alias(n)), (lambda n: F.array(F.lit(word)).alias(n)), F.lit(word).alias("created_at")
    price = F.col("o_totalprice") * (1 if word == "first" else 2)
    return {
        "spots": o.select(place.alias("place_id")).distinct().select("place_id", F.concat(F.lit(f"{word} "), "place_id").alias("spot_id"), *(said(c) for c in _SPOTS), stamp),
        "videos": o.select(video.alias("video_id")).distinct().select("video_id", *(said(c) for c in ("title", "description", "video_path", "source_url", "language")), stamp),
        "video_segments": o.select(key.alias("segment_id"), video.alias("video_id"), place.alias("place_id"), price.alias("start_time"), (price + 1).alias("end_time"), *(said(c) for c in ("caption", "summary", "region", "drama_title", "spot_name", "keyframe_path", "metadata")), *(listed(c) for c in ("tags", "mood_tags", "season_tags")), stamp),
        "segment_embeddings": o.select(key.alias("segment_id"), F.array(price).alias("text_embedding"), stamp),
        "segment_keyframes": o.select(F.concat(key, F.lit("_k")).alias("keyframe_id"), key.alias("segment_id"), F.concat(F.lit("p/"), key).alias("keyframe_path"), *(said(c) for c in ("description", "time_of_day", "metadata")), *(listed(c) for c in ("mood", "activity", "scene_elements")), stamp),
        "keyframe_embeddings": o.select(F.concat(key, F.lit("_k")).alias("keyframe_id"), F.array(price).alias("image_embedding"), stamp),
    }


def _said(names: str, word: str = "w") -> str:
    return " || '|' || ".join(f"'{n} ' || {word}" for n in names.split())


_LOADED = f"""WITH a AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0),
g AS (SELECT o_orderkey::VARCHAR AS k, o_custkey::VARCHAR AS v, 'P' || (o_custkey % 7) AS p, o_totalprice * 2 AS x, 'second' AS w, CASE WHEN o_orderkey % 3 <> 0 THEN 'first' ELSE 'second' END AS made FROM b),
v AS (SELECT o_custkey::VARCHAR AS k, max(w) AS w, min(w) AS made FROM (SELECT o_custkey, 'first' AS w FROM a UNION SELECT o_custkey, 'second' FROM b) GROUP BY 1),
s AS (SELECT p AS k, max(w) AS w, min(w) AS made FROM (SELECT 'P' || (o_custkey % 7) AS p, 'first' AS w FROM a UNION SELECT 'P' || (o_custkey % 7), 'second' FROM b) GROUP BY 1)
SELECT 'spots' AS "table", k AS key, made || ' ' || k || '|' || {_said(' '.join(_SPOTS))} || '|' || made AS row FROM s WHERE k <> 'P3'
UNION ALL SELECT 'videos', k, {_said('title description video_path')} || '|' || 'source_url ' || made || '|' || {_said('language')} || '|' || made FROM v
UNION ALL SELECT 'video_segments', g.k, v || '|' || p || '|' || CASE WHEN p = 'P3' THEN 'none' ELSE s.made || ' ' || p END || '|' || round(x * 100)::BIGINT || '|' || {_said('caption summary region drama_title spot_name keyframe_path metadata', 'g.w')} || '|' || g.w || '|' || g.w || '|' || g.w || '|' || g.made FROM g JOIN s ON s.k = g.p
UNION ALL SELECT 'segment_embeddings', k, round(x * 100)::BIGINT || '|second' FROM g
UNION ALL SELECT 'segment_keyframes', k || '_k', k || '|p/' || k || '|' || {_said('description time_of_day metadata')} || '|' || w || '|' || w || '|' || w || '|' || made FROM g
UNION ALL SELECT 'keyframe_embeddings', k || '_k', round(x * 100)::BIGINT || '|second' FROM g"""
_SHOWN = {
    "spots": ["spot_id", *_SPOTS, "created_at"],
    "videos": ["title", "description", "video_path", "source_url", "language", "created_at"],
    "video_segments": ["video_id", "place_id", "spot_id", "start_time", "caption", "summary", "region", "drama_title", "spot_name", "keyframe_path", "metadata", "tags", "mood_tags", "season_tags", "created_at"],
    "segment_embeddings": ["text_embedding", "created_at"],
    "segment_keyframes": ["segment_id", "keyframe_path", "description", "time_of_day", "metadata", "mood", "activity", "scene_elements", "created_at"],
    "keyframe_embeddings": ["image_embedding", "created_at"],
}


@query("store_load", _LOADED)
def store_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into one store: stale rows go, known rows take all columns but stamps and spot ids; then a spot is deleted."""
    root = scratch(spark)
    store.load(spark, root, _store_tables(spark, sf_dir, "o_orderkey % 3 <> 0", "first"))
    store.load(spark, root, _store_tables(spark, sf_dir, "o_orderkey % 2 = 0", "second"))
    store.delete(spark, root, "spots", store.read(spark, root)["spots"].filter("place_id = 'P3'"))
    out = None
    for name, rows in store.read(spark, root).items():
        kinds = dict(rows.dtypes)
        cents = lambda x: F.round(x * 100).cast("long").cast("string")
        text = lambda c: cents(F.col(c)) if kinds[c] == "double" else F.array_join(F.transform(c, cents if "double" in kinds[c] else F.lower), ",") if kinds[c].startswith("array") else F.coalesce(c, F.lit("none"))  # noqa: B023, E731
        part = rows.select(F.lit(name).alias("table"), F.col(store.KEYS[name]).alias("key"), F.concat_ws("|", *(text(c) for c in _SHOWN[name])).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


@query("stream_upsert", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id, arg_min(event_type, CASE WHEN event_id % 3 = m THEN event_id END) IS NOT NULL AS kept FROM (SELECT *, min(event_id % 3) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in files, several a micro-batch; the newest event of each user wins, in whatever order they come."""
    root = scratch(spark)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    for k in range(3):
        e.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).repartition(4).write.mode("append").parquet(f"{root}/in")
    incremental.run_stream(spark, f"{root}/in", "user_id long, event_id long, value double, event_type string", "user_id", "event_id", ["value", "event_id"], f"{root}/out", f"{root}/checkpoint", files=4)
    return incremental.latest(spark, f"{root}/out").select("user_id", "value", "event_id", F.col("event_type").isNotNull().alias("kept"))


def _priced(record: dict) -> dict:
    """A record's work that fails for one order in seven, and returns what does not fit for one in eleven."""
    if record["o_orderkey"] % 7 == 3:
        raise ValueError(f"order {record['o_orderkey']}")
    if record["o_orderkey"] % 11 == 5:
        return {"price": "not a number"}
    return {"price": record["o_totalprice"] * 2, "cents": int(round(record["o_totalprice"] * 100))}


_FAILS = "o_orderkey % 7 = 3 OR o_orderkey % 11 = 5"


@query("failure_isolation", f"SELECT o_orderkey, CASE WHEN {_FAILS} THEN 'failed' ELSE 'completed' END AS status, CASE WHEN {_FAILS} THEN 3 ELSE 1 END::INT AS attempts, CASE WHEN o_orderkey % 7 = 3 THEN 'ValueError: order ' || o_orderkey WHEN o_orderkey % 11 = 5 THEN 'ArrowInvalid' END AS error, CASE WHEN NOT ({_FAILS}) THEN o_totalprice * 2 END AS price, CASE WHEN NOT ({_FAILS}) THEN round(o_totalprice * 100)::BIGINT END AS cents FROM orders")
def failure_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status row a record, in a run over all orders: earlier results of some, and a function that raises for others."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    process = lambda todo: records.isolated(todo, _priced, "price double, cents long", retries=2).drop("o_totalprice")
    first = kept(process(orders.filter("o_orderkey % 2 = 0")))
    rows = incremental.run_batch(orders, first, "o_orderkey", process)
    return rows.withColumn("error", F.when(F.col("error").startswith("Arrow"), F.substring_index("error", ":", 1)).otherwise(F.col("error")))


@query("stream_quarantine", "SELECT event_id, 'failed' AS status, 'ValueError: negative' AS error, NULL::DOUBLE AS root FROM events WHERE value - 100 < 0 UNION ALL SELECT max(event_id), 'completed', NULL, sqrt(arg_max(value, event_id) - 100) FROM events WHERE value >= 100 GROUP BY user_id")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose records may fail: those are in quarantine, the newest of each user's others in the table."""
    root = scratch(spark)
    table(spark, sf_dir, "events").select("user_id", "event_id", "value").repartition(6).write.parquet(f"{root}/in")

    def rooted(record: dict) -> dict:
        if record["value"] < 100:
            raise ValueError("negative")
        return {"root": (record["value"] - 100) ** 0.5}

    process = lambda rows: records.isolated(rows, rooted, "root double", retries=0)
    incremental.run_stream(spark, f"{root}/in", "user_id long, event_id long, value double", "user_id", "event_id", ["value", "event_id", "root"], f"{root}/out", f"{root}/checkpoint", process, files=3)
    columns = ["event_id", "status", "error", "root"]
    return incremental.quarantined(spark, f"{root}/out").select(*columns).unionByName(incremental.latest(spark, f"{root}/out").select(*columns))
