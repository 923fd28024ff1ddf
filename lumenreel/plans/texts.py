"""Text, list, identifier and JSON operators over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.operators import segments as G
from lumenreel.operators import tagging
from lumenreel.plans import query
from lumenreel.plans.common import table

_MARK = "CASE doc_id % 5 WHEN 0 THEN ' UnKnown ' WHEN 1 THEN '   ' WHEN 2 THEN NULL ELSE '  ' || source || ' ' END"


@query("null_text", f"SELECT doc_id, nullif(nullif(trim({_MARK}), ''), 'UnKnown') AS tidy, coalesce(nullif(nullif(trim({_MARK}), ''), 'UnKnown'), '') AS filled FROM documents")
def null_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_MARK).alias("x")).select("doc_id", T.text_or_null(F.col("x")).alias("tidy"), T.text_or_empty(F.col("x")).alias("filled"))


@query("unique_strings", "WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '' AND lower(x) <> 'unknown') AS a FROM conversations) SELECT conv_id, turn, array_to_string(list_reduce(list_transform(a, lambda x: [x]), lambda acc, x: CASE WHEN list_contains(list_transform(acc, lambda y: lower(y)), lower(x[1])) THEN acc ELSE list_concat(acc, x) END, []::VARCHAR[]), '|') AS folded, len(list_distinct(a)) AS exact FROM w")
def unique_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split("text", r"\s+"), lambda x: (x != "") & (F.lower(x) != "unknown"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", w.alias("a"))
    return rows.select("conv_id", "turn", F.array_join(T.unique_strings(F.col("a")), "|").alias("folded"), F.size(T.unique_exact(F.col("a"))).cast("long").alias("exact"))


_KO = "'서울 ' || doc_id || ' 남산\t타워! ' || source || '(봄)　꽃'"


@query("hangul_only", f"SELECT doc_id, trim(regexp_replace(regexp_replace({_KO}, '[^가-힣0-9\\s　]', ' ', 'g'), '[\\s　]+', ' ', 'g')) AS clean FROM documents")
def hangul_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.hangul_only(F.expr(_KO)).alias("clean"))


@query("without_words", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '꽃,나무 ' || doc_id ELSE '꽃,강 ' || doc_id || ',바다' END AS kept FROM documents")
def without_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("꽃!"), F.lit("자막"), F.concat(F.lit("나무-"), "doc_id"), F.lit("꽃"))).otherwise(F.array(F.lit("꽃"), F.concat(F.lit("강 "), "doc_id"), F.lit("abc"), F.lit("바다")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.without_words(words, ["자막", "화면"]), ",").alias("kept"))


@query("without_phrases", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source || ' 관련 드라마 촬영 장면입니다.' ELSE source || ' 장면 ' || doc_id END AS description FROM documents")
def without_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("doc_id") % 4 == 0, F.lit(" 이 영상은  여기서 ")).otherwise(F.concat(F.col("source"), F.lit("   장면 이 영상은 "), F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", T.without_phrases(c, ["이 영상은", "여기서"], F.col("source")).alias("description"))


@query("safe_names", r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'video') AS name, 'S' || page_id || '__' || regexp_replace(list_last(string_split(url, '/')), '^(.+)\.[^.]*$', '\1') AS keyframe_id FROM pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"), T.keyframe_id(F.concat(F.lit("S"), "page_id"), F.col("url")).alias("keyframe_id"))


@query("timecodes", "SELECT event_id, format('{:02d}:{:02d}:{:02d}.{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS code, round(mid, 6) AS mid FROM (SELECT event_id, round_even(value * 37 * 1000, 0)::BIGINT AS ms, CASE WHEN event_id % 2 = 0 THEN value ELSE (value + value * 3) / 2 END AS mid FROM events)")
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = F.when(F.col("event_id") % 2 == 0, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", T.timecode(F.col("value") * 37).alias("code"), F.round(T.midpoint_unless(rep, F.col("value"), F.col("value") * 3), 6).alias("mid"))


@query("rescued_json", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN json_extract_string(props, '$.k') WHEN 2 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def rescued_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    reply = F.expr("event_id % 4")
    reply = F.when(reply == 0, F.concat(F.lit("Sure:\n```"), F.col("props"), F.lit("```"))).when(reply == 1, F.concat(F.lit(' {"k": "'), k, F.lit(" "))).when(reply == 2, F.lit("no object at all")).otherwise(F.col("props"))
    v = T.rescued_json(reply)
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"))


@query("expected_seasons", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '겨울' WHEN doc_id % 3 = 0 THEN '봄,여름' WHEN doc_id % 3 = 1 THEN '가을' ELSE '' END AS seasons FROM documents")
def expected_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 3
    given = F.when(m == 0, " 봄, ,여름 ").when(m == 1, "  ")
    season = F.when(m == 1, "가을")
    verified = F.when(F.col("doc_id") % 7 == 0, "겨울").when(F.col("doc_id") % 7 == 1, "summer")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.expected_seasons(given, season, verified), ",").alias("seasons"))


@query("derived_tags", "SELECT p_partkey, array_to_string(list_distinct_in_order, '|') AS tags, mood_tags, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS season_tag, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS spot_name FROM (SELECT *, list_reduce(list_transform(list_concat(string_split(p_name, ' '), [upper(p_type), p_brand, lower(p_brand)]), lambda x: [x]), lambda acc, x: CASE WHEN list_contains(list_transform(acc, lambda y: lower(y)), lower(x[1])) THEN acc ELSE list_concat(acc, x) END, []::VARCHAR[]) AS list_distinct_in_order, p_brand AS mood_tags FROM part)")
def derived_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    season = F.when(F.col("p_partkey") % 3 == 0, "unknown").otherwise(F.col("p_type"))
    tags = G.derived_tags(season, F.split("p_name", " "), F.array(F.upper("p_type"), "p_brand", F.lower("p_brand")), F.array("p_brand", F.upper("p_brand")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" "), F.col("p_name"))
    rows = p.select("p_partkey", *(c.alias(n) for n, c in tags.items()))
    return rows.select("p_partkey", F.array_join("tags", "|").alias("tags"), F.array_join("mood_tags", "|").alias("mood_tags"), F.get("season_tags", F.lit(0)).alias("season_tag"), "spot_name")


_REPLY = """CASE event_id % 5 WHEN 0 THEN '{"mood": ["' || event_type || '"], "activity": ["walk", "walk"]}' WHEN 1 THEN '{"mood": ["nonsense"], "activity": ["walk"]}' WHEN 2 THEN '{"mood": [], "activity": ["eat"]}' WHEN 3 THEN 'garbage' ELSE '{"mood": ["click"]}' END"""


@query("tag_records", "SELECT event_id, event_id % 5 IN (0, 2) AS tags_ok, CASE WHEN event_id % 5 = 0 THEN event_type ELSE 'calm' END AS mood, CASE event_id % 5 WHEN 0 THEN 'walk' WHEN 2 THEN 'eat' ELSE 'watch' END AS activity FROM events")
def tag_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = ["click", "error", "purchase", "signup", "view", "login", "logout", "search"]
    rows = e.select("event_id", F.expr(_REPLY).alias("reply"))
    tags = tagging.tag_record(tagging.parsed_tags(F.col("reply"), ["mood", "activity"]), {"mood": kinds, "activity": ["walk", "eat", "watch"]}, {"mood": ["calm"], "activity": ["watch"]})
    rows = rows.select("event_id", *(c.alias(n) for n, c in tags.items()))
    return rows.select("event_id", "tags_ok", F.array_join("mood", "|").alias("mood"), F.array_join("activity", "|").alias("activity"))


_MISSING = "|".join(f"missing {n}" for n in G.REQUIRED)


@query("metadata_validation", f"""WITH e AS (SELECT event_id, value - 100 AS a, event_id % 3 - 1 AS c, event_id % 7 AS k FROM events)
SELECT event_id AS item_idx, CASE k WHEN 1 THEN 'not an object' WHEN 5 THEN '{_MISSING}' ELSE concat_ws('|', CASE WHEN k = 2 THEN 'missing keyframe_path' END, CASE WHEN k IN (4, 6) THEN 'blank segment_id' END,
CASE WHEN k IN (2, 6) THEN 'blank description' END, CASE WHEN k = 2 THEN 'start_time is not a number' END, CASE WHEN k <> 2 AND a < 0 THEN 'negative start_time' END, CASE WHEN k <> 2 AND c <= 0 THEN 'start_time is not before end_time' END, CASE WHEN k = 4 THEN 'mood is not a list' END) END AS errors,
CASE WHEN k NOT IN (1, 4, 5) AND event_id % 2 = 0 THEN 'repeated values in mood' ELSE '' END AS warnings FROM e""")
def metadata_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items made of the events' values; a nested object has the names of required fields, which do not count."""
    k = F.col("event_id") % 7
    start = F.col("value") - 100
    pair = lambda name, value: F.concat(F.lit(f', "{name}": '), value)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    mood = F.concat(F.lit("["), quoted(F.col("event_type")), F.lit(", "), quoted(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("other")), F.lit("]"))
    item = F.concat(
        F.lit('{"extra": {"segment_id": "in", "description": "in", "start_time": 1}'),
        pair("segment_id", F.when(k == 4, quoted(F.lit(" "))).when(k == 6, F.lit("7")).otherwise(quoted(F.col("event_id").cast("string")))),
        pair("video_id", quoted(F.col("user_id").cast("string"))),
        pair("spot_name", F.lit("null")),
        F.when(k == 2, F.lit("")).otherwise(pair("keyframe_path", quoted(F.concat(F.lit("k/"), "event_id")))),
        pair("start_time", F.when(k == 2, F.lit("true")).otherwise(start.cast("string"))),
        pair("end_time", (start + (F.col("event_id") % 3 - 1) * 5).cast("string")),
        pair("description", F.when(k == 2, quoted(F.lit("  "))).when(k == 6, F.lit("null")).otherwise(quoted(F.col("event_type")))),
        pair("mood", F.when(k == 4, quoted(F.col("event_type"))).otherwise(mood)),
        F.lit("}"),
    )
    text = F.when(k == 1, F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]"))).when(k == 5, F.lit('{"extra": {"segment_id": "in", "description": "in"}}')).otherwise(item)
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_idx"), F.parse_json(text).alias("item"))
    return G.validated_metadata(raw).select("item_idx", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))
