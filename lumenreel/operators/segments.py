"""Segments: metadata validation, manual segments, search-text building, and preparation of records to load."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.functions.vectors import is_vector
from lumenreel.operators import tables
from lumenreel.operators.encoders import Encoder

REQUIRED = ("segment_id", "video_id", "spot_name", "keyframe_path", "start_time", "end_time", "description")
LISTS = ("mood", "scene_elements", "activity")
# What follows a video's id in its title and description.
VIDEO_TITLE = " 관광 영상"
VIDEO_DESCRIPTION = "의 VLM 기반 관광 영상"


def validated_metadata(raw: DataFrame) -> DataFrame:
    """``raw(item_idx, item variant)`` with ``segment_id``, ``errors`` and ``warnings``.

    Items are variants, so that a wrongly typed value is reported and not nulled.  Only fields of the top level count.
    An item that is not an object is an error of its own; booleans are not numbers.  Each field is read once, in a
    projection below the tests.
    """
    texts, numbers = ("segment_id", "description"), ("start_time", "end_time")
    rows = raw.select("item_idx", "item", F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False)).alias("whole"))
    rows = rows.select("item_idx", "whole", F.when(F.col("whole"), F.try_variant_get("item", "$", "map<string,variant>")).alias("m"))
    rows = rows.select("item_idx", "whole", F.map_keys("m").alias("names"), *(F.try_element_at("m", F.lit(n)).alias(n) for n in (*texts, *numbers, *LISTS)))
    rows = rows.select("*", *(F.schema_of_variant(n).alias(f"{n}_kind") for n in (*texts, *numbers, *LISTS)))
    number = lambda n: F.when(F.col(f"{n}_kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(n, "$", "double"))
    values = lambda n: F.when(F.col(f"{n}_kind").startswith("ARRAY"), F.try_variant_get(n, "$", "array<string>"))
    said = lambda n: F.try_variant_get(n, "$", "string")
    full = lambda n: (F.col(f"{n}_kind") == "STRING") & (T.strip(said(n)) != "")
    rows = rows.select("item_idx", "whole", "names", said("segment_id").alias("segment_id"), *(F.coalesce(full(n), F.lit(False)).alias(f"{n}_full") for n in texts), *(number(n).alias(n) for n in numbers), *(values(n).alias(n) for n in LISTS))
    has = lambda n: F.array_contains("names", n)
    start, end = F.col("start_time"), F.col("end_time")
    tests = [(has(n), f"missing {n}") for n in REQUIRED]
    tests += [(~has(n) | F.col(f"{n}_full"), f"blank {n}") for n in texts]
    tests += [(~has(n) | F.col(n).isNotNull(), f"{n} is not a number") for n in numbers]
    tests += [(start.isNull() | (start >= 0), "negative start_time"), (start.isNull() | end.isNull() | (start < end), "start_time is not before end_time")]
    tests += [(~has(n) | F.col(n).isNotNull(), f"{n} is not a list") for n in LISTS]
    repeated = [F.when(F.size(F.array_distinct(n)) < F.size(n), F.lit(f"repeated values in {n}")) for n in LISTS]
    errors = F.when(F.col("whole"), tables.errors_of(tests)).otherwise(F.array(F.lit("not an object")))
    return rows.select("item_idx", "segment_id", errors.alias("errors"), F.array_compact(F.array(*repeated)).alias("warnings"))


def manual_errors(duration: Column, slack: float = 0.1) -> Column:
    """Error codes of a manual segment (segment_id, video_id, source_filename, start_time, end_time as text, ...)."""
    num = lambda n: F.col(n).cast("string").try_cast("double")
    start, end, rep = num("start_time"), num("end_time"), num("representative_frame_time")
    full = lambda n: T.strip(F.col(n)) != ""
    return tables.errors_of(
        [(full(n), f"missing {n}") for n in ("segment_id", "video_id", "source_filename")]
        + [(start.isNotNull(), "start_time is not a number"), (end.isNotNull(), "end_time is not a number"), (start.isNull() | (start >= 0), "negative start_time")]
        + [(start.isNull() | end.isNull() | (start < end), "start_time is not before end_time"), (end.isNull() | duration.isNull() | (end <= duration + slack), "end_time is after the video")]
        + [(F.col("representative_frame_time").isNull() | start.isNull() | end.isNull() | ((start <= rep) & (rep < end)), "representative frame is outside")]
    )


def gaps_and_overlaps(rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Gaps and overlaps between a video's successive segments: video_id, before, after, kind, seconds."""
    w = W.partitionBy("video_id").orderBy("start_time", "item_idx")
    diff = F.col("start_time") - F.lag("end_time").over(w)
    rows = rows.select("video_id", F.lag("segment_id").over(w).alias("before"), F.col("segment_id").alias("after"), diff.alias("diff")).filter(F.abs("diff") > tolerance)
    return rows.select("video_id", "before", "after", F.when(F.col("diff") > 0, "gap").otherwise("overlap").alias("kind"), F.round(F.abs("diff"), 3).alias("seconds"))


def manual_segments(rows: DataFrame, durations: DataFrame) -> DataFrame:
    """Result table of manual segments: time codes, durations, representative time, state; invalid ones carry errors."""
    rows = rows.join(durations.select("video_id", F.col("duration").alias("source_duration_time")), "video_id", "left")
    errors = manual_errors(F.col("source_duration_time"))
    start, end = F.col("start_time").cast("double"), F.col("end_time").cast("double")
    rep = T.midpoint_unless(F.col("representative_frame_time").cast("double"), start, end)
    ok = F.size("errors") == 0
    rows = rows.withColumn("errors", errors)
    return rows.select("segment_id", "video_id", start.alias("start_time"), end.alias("end_time"), T.timecode(start).alias("start_timecode"), T.timecode(end).alias("end_timecode"), F.round(end - start, 3).alias("duration_time"), F.round(rep, 3).alias("representative_frame_time"), ok.alias("time_verified"), F.when(ok, "needs_review").otherwise("needs_time_fix").alias("review_status"), F.array_join("errors", "; ").alias("notes"))


# ---- search texts and records to load


def segment_texts(items: DataFrame, columns: dict[str, str], key: str = "segment_id", order: str = "item_idx") -> DataFrame:
    """One search text per segment: the distinct texts of its items in order; ``columns``: role -> column."""
    rows = items.select(key, order, T.search_text({k: F.col(c) for k, c in columns.items()}).alias("text"))
    grouped = tables.grouped_items(rows, key, order, ["text"])
    return grouped.select(key, F.array_join(T.unique_strings(F.transform("items", lambda x: x["text"])), ". ").alias("search_text"), F.size("items").alias("n_items"))


def derived_tags(season: Column, scene: Column, activity: Column, mood: Column, spot: Column, place: Column) -> dict[str, Column]:
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(scene, empty), F.coalesce(activity, empty))
    s = T.text_or_null(season)
    return {"tags": T.unique_strings(both), "mood_tags": T.unique_strings(mood), "season_tags": F.when(s.isNotNull(), F.array(s)).otherwise(empty), "spot_name": F.coalesce(T.text_or_null(spot), T.text_or_null(place))}


def encoded(rows: DataFrame, column: str, encode: Encoder | Callable[[pd.Series], Sequence[Sequence[float]]], dimension: int, name: str) -> DataFrame:
    """``rows`` with the vector that an encoder gives for ``column``; a wrong dimension is an error.

    An ``Encoder`` is loaded once a Python worker and fed by cost; a plain function is called with each batch's column.
    """
    model = encode if isinstance(encode, Encoder) else Encoder(name, lambda: encode, dimension)
    if model.dimension != dimension:
        raise ValueError(f"{model.name} gives {model.dimension} numbers, not {dimension}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if isinstance(encode, Encoder):
                vectors = model.encode(b[column].tolist())
            else:
                vectors = [np.asarray(v, np.float32) for v in encode(b[column])]
                if any(v.shape != (dimension,) or not np.isfinite(v).all() for v in vectors):
                    raise ValueError(f"{name} is not a vector of {dimension} finite numbers")
            yield b.assign(**{name: vectors})

    return rows.mapInPandas(run, rows.withColumn(name, F.array().cast("array<double>" if model.double else "array<float>")).schema)


def embedding_records(items: DataFrame, columns: dict[str, str], encode_text: Callable, encode_image: Callable, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(segment vectors, keyframe vectors) of metadata items: texts per segment, keyframe ids and paths per item."""
    texts = segment_texts(items, columns)
    segments = encoded(texts.select("segment_id", "search_text"), "search_text", encode_text, dimension, "text_embedding")
    frames = items.select(T.keyframe_id(F.col("segment_id"), F.col("keyframe_path")).alias("keyframe_id"), "segment_id", "keyframe_path", "item_idx")
    frames = tables.last_of(frames, "keyframe_id", "item_idx")
    return segments, encoded(frames.drop("item_idx"), "keyframe_path", encode_image, dimension, "image_embedding")


def prepared_records(items: DataFrame, segment_vectors: DataFrame, keyframe_vectors: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(segments, keyframes) ready to load; errors if keys do not match or a vector is bad.

    Attributes come from a segment's first item; of items with one path the last counts.
    """
    tables.require_reconciled(items, segment_vectors, "segment_id")
    tables.require_reconciled(items, keyframe_vectors, "keyframe_path")
    by_path = tables.last_of(items, "keyframe_path", "item_idx")
    row = tables.disagreements(by_path, keyframe_vectors, "keyframe_path", "segment_id").first()
    if row is not None:
        raise ValueError(f"{row[0]!r} belongs to {row.value_a!r} and to {row.value_b!r}")
    for t, c in ((segment_vectors, "text_embedding"), (keyframe_vectors, "image_embedding")):
        if not t.filter(~is_vector(F.col(c), dimension)).isEmpty():
            raise ValueError(f"{c} has vectors that are not {dimension} finite numbers")
    first = tables.first_of(items.drop("keyframe_path"), "segment_id", "item_idx")
    packed = items.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("item_idx", "keyframe_path"))).alias("metadata"))
    segments = first.join(packed, "segment_id").join(segment_vectors.select("segment_id", "text_embedding"), "segment_id")
    frames = by_path.join(keyframe_vectors.select("keyframe_path", "image_embedding"), "keyframe_path")
    return segments, frames.withColumn("keyframe_id", T.keyframe_id(F.col("segment_id"), F.col("keyframe_path")))


def video_rows(items: DataFrame) -> DataFrame:
    """One row per video: title and description from its id, no file yet, language."""
    first = items.select("video_id").distinct()
    say = lambda words: F.concat("video_id", F.lit(words))
    return first.select("video_id", say(VIDEO_TITLE).alias("title"), say(VIDEO_DESCRIPTION).alias("description"), F.lit(None).cast("string").alias("video_path"), F.lit("ko").alias("language"))


def with_places(segments: DataFrame, spots: DataFrame) -> DataFrame:
    """Segments with the ``spot_id`` of their place; null where the place is not known. The optimizer picks the join by size."""
    return segments.join(spots.select("place_id", "spot_id"), "place_id", "left")
