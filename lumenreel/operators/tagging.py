"""Tags of segments from captions and model replies: scripts, annotators, vocabulary checks and defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.operators.scenes import overlapping

NO_SCRIPT = "no captions"
# Scene elements where a segment has no place after a failed reply, and where no entry is left.
FAILED_SCENE = "촬영지"
EMPTY_SCENE = "풍경"
ATTEMPTS = 3


def flattened(catalog: DataFrame) -> DataFrame:
    """One row per segment of a catalog of titles, places and segments; missing fields get defaults."""
    places = catalog.select("video_id_prefix", F.coalesce("drama_title", F.lit("unknown")).alias("drama_title"), F.explode("places").alias("p"))
    rows = places.select("video_id_prefix", "drama_title", F.col("p.place_id").alias("place_id"), F.coalesce("p.place_name", F.lit("unknown")).alias("place_name"), F.coalesce("p.region", F.lit("unknown")).alias("region"), F.col("p.youtube_id").alias("youtube_id"), F.posexplode("p.segments").alias("segment_pos", "s"))
    return rows.select("*", F.col("s.segment_id").alias("segment_id"), F.coalesce("s.start_time", F.lit(0.0)).alias("start_time"), F.coalesce("s.end_time", F.lit(0.0)).alias("end_time"), F.coalesce("s.description", F.lit("")).alias("description")).drop("s")


def flattened_sources(config: DataFrame) -> DataFrame:
    """One row per source of the groups of a configuration, with ``config_error`` for blank ids or file names."""
    rows = config.select("drama_title", "region", F.explode("sources").alias("s")).select("drama_title", "region", "s.*")
    blank = lambda c: F.coalesce(T.strip(F.col(c)), F.lit("")) == ""
    return rows.withColumn("config_error", blank("video_id") | blank("filename"))


def scripts(segments: DataFrame, captions: DataFrame, key: str = "youtube_id", width: float = 60.0) -> DataFrame:
    """``segments`` with ``script``: the text of all captions that touch them, in time order, or NO_SCRIPT."""
    rows = captions.select(key, F.col("start").cast("double").alias("start"), (F.col("start") + F.coalesce("duration", F.lit(0.0))).alias("end"), "text")
    pairs = overlapping(segments.select(key, "segment_id", "start", "end"), rows, key, width)
    found = pairs.groupBy(F.col("x.segment_id").alias("segment_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("y.start").alias("at"), F.col("y.text").alias("text")))).alias("lines"))
    script = F.array_join(F.transform("lines", lambda x: x["text"]), " ")
    return segments.join(found, "segment_id", "left").withColumn("script", F.coalesce(T.text_not_empty(script), F.lit(NO_SCRIPT))).drop("lines")


def annotated(rows: DataFrame, inputs: Sequence[str], annotate: Callable[..., str], name: str = "reply") -> DataFrame:
    """``rows`` with a user annotator's reply; after ATTEMPTS failures the reply is null."""
    schema = rows.withColumn(name, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies = []
            for args in zip(*(b[c] for c in inputs), strict=True):
                reply = None
                for _ in range(ATTEMPTS):
                    try:
                        reply = annotate(*args)
                        break
                    except Exception:  # noqa: BLE001  a user's function: the defaults take over
                        reply = None
                replies.append(reply)
            yield b.assign(**{name: replies})

    return rows.mapInPandas(run, schema)


def in_vocabulary(tags: Column, vocabulary: Sequence[str]) -> Column:
    return F.size(F.array_except(tags, F.lit(list(vocabulary)))) == 0


def parsed_tags(reply: Column, fields: Sequence[str]) -> dict[str, Column]:
    v = T.rescued_json(reply)
    return {f: F.try_variant_get(v, f"$.{f}", "array<string>") for f in fields}


def tag_record(tags: Mapping[str, Column], vocabularies: Mapping[str, Sequence[str]], defaults: Mapping[str, Sequence[str]], complete: Column | None = None) -> dict[str, Column]:
    """Tags with defaults: all of them if any field is missing or out of its vocabulary, else those of empty lists.

    ``complete``: whether a reply has its other fields.
    """
    ok = F.lit(True) if complete is None else F.coalesce(complete, F.lit(False))
    for f, c in tags.items():
        ok = ok & F.coalesce(c.isNotNull() & (in_vocabulary(c, vocabularies[f]) if f in vocabularies else F.lit(True)), F.lit(False))
    out = {"tags_ok": ok}
    for f, c in tags.items():
        default = F.lit(list(defaults[f])).cast("array<string>")
        out[f] = F.when(~ok | (F.size(c) == 0), default).otherwise(F.array_distinct(c))
    return out


def tagged_catalog(segments: DataFrame, captions: DataFrame, annotate: Callable[..., str], vocabularies: Mapping[str, Sequence[str]], defaults: Mapping[str, Sequence[str]], banned_words: Sequence[str] = (), banned_phrases: Sequence[str] = ()) -> DataFrame:
    """Segments with scripts, an annotator's tags (checked, with defaults), a free tag list and a clean description.

    A reply counts as a whole: if a field is missing or out of its vocabulary, nothing of it is used, and ``tags_ok`` is
    false.  The free list then holds the cleaned place, as it does where no entry is left.
    """
    rows = annotated(scripts(segments, captions), ["drama_title", "place_name", "region", "script"], annotate)
    free = F.try_variant_get(T.rescued_json(F.col("reply")), "$.scene_elements", "array<string>")
    text = F.try_variant_get(T.rescued_json(F.col("reply")), "$.description", "string")
    rows = rows.withColumns({"_free": free, "_text": text})
    rows = rows.withColumns(tag_record(parsed_tags(F.col("reply"), list(vocabularies)), vocabularies, defaults, F.col("_free").isNotNull() & F.col("_text").isNotNull()))
    place, ok = T.hangul_only(F.col("place_name")), F.col("tags_ok")
    some = T.without_words(F.col("_free"), banned_words)
    instead = F.when(~ok, F.when(T.text_not_empty(F.col("place_name")).isNull(), FAILED_SCENE).otherwise(place)).otherwise(F.coalesce(T.text_not_empty(place), F.lit(EMPTY_SCENE)))
    rows = rows.withColumn("scene_elements", F.when(ok & (F.size(some) > 0), some).otherwise(F.array(instead)))
    return rows.withColumn("description", T.without_phrases(F.when(ok, F.col("_text")).otherwise(""), banned_phrases, F.col("place_name"))).drop("reply", "_free", "_text")
