"""Scene operators: events are the frames of one series per user, days and orders stand in for scenes and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.functions import scores as S
from lumenreel.operators import frames as X
from lumenreel.operators import scenes as C
from lumenreel.operators import segments as G
from lumenreel.operators import tables as T
from lumenreel.operators import tagging
from lumenreel.plans import query
from lumenreel.plans.common import SERIES, series, table
from lumenreel.plans.search import DAY_HISTOGRAMS, histograms

DAY, END = 86_400.0, 30 * 86_400.0
RULES = {
    "base_cut_threshold": 0.3, "adaptive_mad_multiplier": 1.5, "minimum_cut_gap_seconds": DAY, "transition_padding_seconds": 600.0, "minimum_scene_seconds": 7200.0,
    "maximum_scene_seconds": 4 * DAY, "sample_frames_per_scene": 6, "minimum_median_sharpness": 60.0, "minimum_best_frame_sharpness": 100.0, "maximum_blurry_frame_ratio": 0.5,
    "minimum_brightness": 20.0, "maximum_brightness": 60.0, "maximum_dark_pixel_ratio": 0.2, "maximum_overexposed_pixel_ratio": 0.3, "minimum_expected_season_score": 0.2, "maximum_other_season_advantage": 0.1,
}
#: What stands in for a frame's metrics: value divided by this.
METRICS = {
    "green": 900.0, "yellow": 1500.0, "pink": 3000.0, "warm": 1200.0, "brown": 1100.0, "blue": 1000.0, "white": 600.0, "white_upper": 1400.0, "white_lower": 800.0, "white_largest": 1300.0,
    "white_edge": 2000.0, "low_saturation": 700.0, "saturation": 750.0, "brightness": 2.0, "contrast": 5.0, "dark": 2500.0, "over": 2600.0, "edge_density": 2200.0,
}


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("video_id").orderBy("t", "event_id")
    return series(spark, sf_dir).select("video_id", "t", (F.abs(F.col("value") - F.lag("value").over(w)) / 490).alias("diff")).filter("diff is not null")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("video_id").distinct().withColumns({"start": F.lit(0.0), "end": F.lit(END)})


_C1 = f"""WITH {SERIES}, d AS (SELECT video_id, t, abs(value - lag(value) OVER (PARTITION BY video_id ORDER BY t, event_id)) / 490 AS diff FROM s QUALIFY diff IS NOT NULL),
m AS (SELECT video_id, median(diff) AS med, count(*) AS n FROM d GROUP BY 1),
a AS (SELECT video_id, n, CASE WHEN n < 3 THEN 0.3 ELSE greatest(0.3, least(0.78, med + 1.5 * greatest(mad, 0.008))) END AS threshold FROM (SELECT video_id, any_value(n) AS n, any_value(med) AS med, median(abs(diff - med)) AS mad FROM d JOIN m USING (video_id) GROUP BY 1)),
p AS (SELECT video_id, t, round(diff, 4) AS value, round(greatest(0, least(1, (diff - threshold) / greatest(0.1, 1 - threshold) + 0.55)), 3) AS confidence FROM (SELECT *, lag(diff) OVER w AS l, lead(diff) OVER w AS r FROM d WINDOW w AS (PARTITION BY video_id ORDER BY t)) JOIN a USING (video_id) WHERE n >= 3 AND diff >= threshold AND diff >= l AND diff >= r),
g AS (SELECT video_id, list_sort(list_reduce(list([t] ORDER BY confidence DESC, t), lambda acc, x: CASE WHEN len(list_filter(acc, lambda b: abs(b - x[1]) < 86400)) = 0 THEN list_concat(acc, x) ELSE acc END, [0.0]::DOUBLE[])) AS c FROM p GROUP BY 1),
b AS (SELECT video_id, list_append(CASE WHEN len(c) > 1 AND 2592000 - c[-1] < 0.8 THEN c[:-2] ELSE c END, 2592000.0) AS bounds FROM (SELECT DISTINCT s.video_id, coalesce(c, [0.0]::DOUBLE[]) AS c FROM s LEFT JOIN g USING (video_id))),
i AS (SELECT video_id, k - 1 AS scene_idx, len(bounds) - 1 AS n_scenes, bounds[k] AS "start", bounds[k + 1] AS "end" FROM (SELECT video_id, bounds, unnest(range(1, len(bounds))) AS k FROM b)),
c AS (SELECT i.*, (CASE WHEN scene_idx = 0 THEN 0.7 ELSE coalesce(x.confidence, 0.75) END + CASE WHEN scene_idx = n_scenes - 1 THEN 0.7 ELSE coalesce(y.confidence, 0.75) END) / 2 AS confidence FROM i LEFT JOIN p x ON x.video_id = i.video_id AND round(x.t, 3) = round(i."start", 3) LEFT JOIN p y ON y.video_id = i.video_id AND round(y.t, 3) = round(i."end", 3))
"""


@query("cut_thresholds", _C1 + "SELECT video_id, n, round(threshold, 6) AS threshold FROM a")
def cut_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.robust_threshold(_diffs(spark, sf_dir), ["video_id"], 0.3, 1.5)
    return rows.select("video_id", "n", F.round("threshold", 6).alias("threshold"))


@query("cut_peaks", _C1 + "SELECT video_id, t, value, confidence FROM p")
def cut_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diffs(spark, sf_dir)
    return C.peaks(d, C.robust_threshold(d, ["video_id"], 0.3, 1.5), ["video_id"], "t")


@query("scene_detection", _C1 + 'SELECT video_id, scene_idx, n_scenes, "start", "end", round(confidence, 6) AS confidence FROM c')
def scene_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = C.detect_scenes(_diffs(spark, sf_dir), _ranges(spark, sf_dir), ["video_id"], "t", RULES)
    return rows.select("video_id", F.col("scene_idx").cast("long").alias("scene_idx"), F.col("n_scenes").cast("long").alias("n_scenes"), "start", "end", F.round("confidence", 6).alias("confidence"))


@query("padded_scenes", _C1 + 'SELECT * FROM (SELECT video_id, scene_idx, "start" + CASE WHEN scene_idx = 0 THEN 0.15 ELSE 600 END AS "start", "end" - CASE WHEN scene_idx = n_scenes - 1 THEN 0.15 ELSE 600 END AS "end" FROM c) WHERE "end" - "start" >= 7200')
def padded_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = C.detect_scenes(_diffs(spark, sf_dir), _ranges(spark, sf_dir), ["video_id"], "t", RULES)
    return C.padded(rows, 600.0, 7200.0).select("video_id", F.col("scene_idx").cast("long").alias("scene_idx"), "start", "end")


@query("frame_differences", f"WITH {DAY_HISTOGRAMS}, g2 AS (SELECT video_id, day, unnest(histogram) AS x, unnest(before) AS y FROM (SELECT *, lag(histogram) OVER (PARTITION BY video_id ORDER BY day) AS before FROM dh) WHERE before IS NOT NULL) SELECT video_id, day, round(0.58 * sqrt(greatest(0, 1 - sum(sqrt(x * y)) / sqrt(sum(x) * sum(y)))) + 0.24 * avg(abs(x - y)) / 255, 6) AS diff FROM g2 GROUP BY ALL")
def frame_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of a user's days, each against the user's day before."""
    h = histograms(spark, sf_dir, by_day=True)
    return C.frame_differences(h, ["video_id"], "day", "histogram", gray="histogram").select("video_id", "day", F.round("diff", 6).alias("diff"))


@query("frame_differences_edges", f"WITH {DAY_HISTOGRAMS}, g2 AS (SELECT video_id, day, unnest(histogram) AS x, unnest(before) AS y FROM (SELECT *, lag(histogram) OVER (PARTITION BY video_id ORDER BY day) AS before FROM dh) WHERE before IS NOT NULL) SELECT video_id, day, round(0.58 * sqrt(greatest(0, 1 - sum(sqrt(x * y)) / sqrt(sum(x) * sum(y)))) + 0.24 * avg(abs(x - y)) / 255 + 0.18 * avg(abs(x % 5 * 40 - y % 5 * 40)) / 255, 6) AS diff FROM g2 GROUP BY ALL")
def frame_differences_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three parts of a difference: histogram, gray and edges."""
    h = histograms(spark, sf_dir, by_day=True).withColumn("edges", F.transform("histogram", lambda x: x % 5 * 40))
    return C.frame_differences(h, ["video_id"], "day", "histogram", gray="histogram", edges="edges").select("video_id", "day", F.round("diff", 6).alias("diff"))


@query("sample_times", "SELECT event_id, k::INT AS k, round(50 + (value - 50) * (0.08 + 0.84 * k / 4), 6) AS t FROM events, unnest(range(5)) AS r(k) WHERE value > 50 UNION ALL SELECT event_id, -1, round((50 + value) / 2, 6) FROM events WHERE value > 50")
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = series(spark, sf_dir)
    many = e.select("event_id", F.posexplode(C.sample_times(F.lit(50.0), F.col("value"), 5)).alias("k", "t"))
    one = e.select("event_id", F.lit(-1).alias("k"), F.explode(C.sample_times(F.lit(50.0), F.col("value"), 1)).alias("t"))
    return many.union(one).select("event_id", "k", F.round("t", 6).alias("t"))


@query("as_of_frames", f"WITH {SERIES}, q AS (SELECT video_id, k * 43200.0 AS t FROM (SELECT DISTINCT video_id FROM s), unnest(range(60)) AS r(k)), o AS (SELECT video_id, t, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM s GROUP BY 1, 2) SELECT q.video_id, q.t, o.event_id, o.value FROM q ASOF LEFT JOIN o ON q.video_id = o.video_id AND q.t >= o.t")
def as_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = series(spark, sf_dir)
    wanted = e.select("video_id").distinct().select("video_id", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("k")).select("video_id", (F.col("k") * 43200.0).alias("t"))
    frames = T.last_of(e.withColumn("_k", F.struct("video_id", "t")), "_k", "event_id").drop("_k")
    return C.as_of(wanted, frames, ["video_id"], "t", ["event_id", "value"], width=7 * DAY)


@query("caption_overlap", f"WITH {SERIES}, seg AS (SELECT video_id, video_id * 1000 + k AS segment_id, k * 21600.0 AS a, k * 21600.0 + 21600 AS z FROM (SELECT DISTINCT video_id FROM s), unnest(range(120)) AS r(k)), j AS (SELECT segment_id, string_agg(event_type, ' ' ORDER BY t, event_type) AS x FROM seg JOIN s ON s.video_id = seg.video_id AND t + value * 10 >= a AND t <= z GROUP BY 1) SELECT segment_id, coalesce(x, 'no captions') AS script FROM seg LEFT JOIN j USING (segment_id)")
def caption_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = series(spark, sf_dir)
    seg = e.select("video_id").distinct().select(F.col("video_id").alias("youtube_id"), F.explode(F.sequence(F.lit(0), F.lit(119))).alias("k"))
    seg = seg.select("youtube_id", (F.col("youtube_id") * 1000 + F.col("k")).alias("segment_id"), (F.col("k") * 21600.0).alias("start"), (F.col("k") * 21600.0 + 21600).alias("end"))
    captions = e.select(F.col("video_id").alias("youtube_id"), F.col("t").alias("start"), (F.col("value") * 10).alias("duration"), F.col("event_type").alias("text"))
    return tagging.scripts(seg, captions, width=7200.0).select("segment_id", "script")


_M = ", ".join(f"value / {d} AS {m}" for m, d in METRICS.items())
_FRAMES = f"f AS (SELECT video_id, floor(t / 432000)::INT AS scene_idx, t, event_id AS frame_idx, value AS sharpness, {_M} FROM s)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("video_id", F.floor(F.col("t") / 432000).cast("int").alias("scene_idx"), "t", F.col("event_id").alias("frame_idx"), F.col("value").alias("sharpness"), *((F.col("value") / d).alias(m) for m, d in METRICS.items()))


@query("scene_medians", f"WITH {SERIES}, {_FRAMES} SELECT video_id, scene_idx, round(median(sharpness), 6) AS sharpness, round(median(green), 6) AS green, round(median(brightness), 6) AS brightness, count(*) AS n_frames, round(avg(CASE WHEN sharpness < 50 THEN 1.0 ELSE 0.0 END), 6) AS blurry_ratio, arg_min(frame_idx, {{'a': -sharpness, 'b': frame_idx}}) AS best_frame FROM f GROUP BY 1, 2")
def scene_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.scene_medians(_frames(spark, sf_dir), ["video_id", "scene_idx"], ["sharpness", "green", "brightness"], 50.0)
    return rows.select("video_id", "scene_idx", *(F.round(c, 6).alias(c) for c in ("sharpness", "green", "brightness")), "n_frames", F.round("blurry_ratio", 6).alias("blurry_ratio"), F.col("best_frame.frame_idx").alias("best_frame"))


_SEASON = f"""{SERIES}, {_FRAMES},
md AS (SELECT video_id, scene_idx, count(*) AS n_frames, max(sharpness) AS best_sharpness, median(sharpness) AS sharpness, avg(CASE WHEN sharpness < 100 THEN 1.0 ELSE 0.0 END) AS blurry_ratio, {", ".join(f"median({m}) AS {m}" for m in METRICS)} FROM f GROUP BY 1, 2),
n AS (SELECT *, least(1, green / 0.30) AS g, least(1, yellow / 0.16) AS ye, least(1, pink / 0.10) AS pk, least(1, warm / 0.20) AS wa, least(1, brown / 0.20) AS br, least(1, blue / 0.28) AS bl, least(1, white / 0.42) AS wh, least(1, white_upper / 0.30) AS wu,
  least(1, white_lower / 0.42) AS wl, least(1, white_largest / 0.24) AS wg, least(1, white_edge / 0.20) AS we, least(1, greatest(0, white - white_largest) / 0.18) AS sc, least(1, low_saturation / 0.70) AS ls, least(1, saturation / 0.55) AS sa, greatest(0, least(1, (brightness - 55) / 125)) AS bt, least(1, contrast / 65) AS ct FROM md),
k AS (SELECT *, least(1, 0.58 * wl + 0.42 * wg) AS snow, greatest(0, least(1, 0.34 * wu + 0.28 * sc + 0.18 * we + 0.12 * g + 0.08 * greatest(pk, ye) - 0.42 * least(1, 0.58 * wl + 0.42 * wg))) AS bs FROM n),
z AS (SELECT *, round(greatest(0, least(1, 0.23 * g + 0.22 * pk + 0.17 * ye + 0.24 * bs + 0.08 * bt + 0.06 * sa)), 5) AS s1,
  round(greatest(0, least(1, 0.55 * g + 0.18 * bl + 0.15 * sa + 0.12 * bt - 0.10 * greatest(pk, ye, bs) - 0.10 * greatest(wa, br) - 0.12 * snow)), 5) AS s2,
  round(greatest(0, least(1, 0.43 * wa + 0.25 * br + 0.17 * ye + 0.08 * ct + 0.07 * bt - 0.13 * snow - 0.07 * bs)), 5) AS s3,
  round(greatest(0, least(1, 0.50 * snow + 0.18 * ls + 0.10 * bl + 0.08 * bt + 0.06 * wh - 0.22 * bs - 0.12 * wa - 0.10 * br - 0.10 * g)), 5) AS s4 FROM k),
y AS (SELECT *, ['봄', '여름', '가을', '겨울'][list_position([s1, s2, s3, s4], greatest(s1, s2, s3, s4))] AS detected, CASE video_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['봄', '여름'] WHEN 2 THEN ['겨울'] ELSE ['가을', 'x'] END AS expected FROM z),
x AS (SELECT *, CASE video_id % 4 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN s1 >= s2 THEN '봄' ELSE '여름' END WHEN 2 THEN '겨울' ELSE '가을' END AS expected_season, CASE video_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN greatest(s1, s2) WHEN 2 THEN s4 ELSE s3 END AS season_score,
  CASE video_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN greatest(s3, s4) WHEN 2 THEN greatest(s1, s2, s3) ELSE greatest(s1, s2, s4) END AS other_score FROM y)
"""


def _expected() -> Column:
    m = F.col("video_id") % 4
    return F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array(F.lit("봄"), F.lit("여름"))).when(m == 2, F.array(F.lit("겨울"))).otherwise(F.array(F.lit("가을"), F.lit("x")))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.scene_medians(_frames(spark, sf_dir), ["video_id", "scene_idx"], ["sharpness", *METRICS], 100.0)
    rows = rows.withColumns({"expected": _expected(), "duration": F.col("n_frames").cast("double"), "confidence": F.lit(0.7)})
    return C.evaluated(rows, RULES)


@query("season_scores", f"WITH {_SEASON} SELECT video_id, scene_idx, s1 AS spring, s2 AS summer, s3 AS autumn, s4 AS winter, detected AS detected_season, expected_season, season_score, other_score FROM x")
def season_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = dict(zip(S.SEASONS, ("spring", "summer", "autumn", "winter"), strict=True))
    return _evaluated(spark, sf_dir).select("video_id", "scene_idx", *(F.col(f"season_scores.{s}").alias(n) for s, n in names.items()), "detected_season", "expected_season", "season_score", "other_score")


def _say(test: str, words: str, digits: int, value: str) -> str:
    return f"CASE WHEN {test} THEN '{words} (' || format('{{:.{digits}f}}', round({value}, {digits})) || ')' END"


#: All texts of failed tests, in their order.
_REASONS = "CASE WHEN n_frames < 4 THEN 'too few readable frames' ELSE concat_ws(' / ', " + ", ".join((
    _say("sharpness < 60", "low median sharpness", 3, "sharpness"), _say("best_sharpness < 100", "low best sharpness", 3, "best_sharpness"), _say("blurry_ratio > 0.5", "too many blurry frames", 2, "blurry_ratio"),
    _say("brightness < 20", "too dark", 1, "brightness"), _say("brightness > 60", "too bright", 1, "brightness"), _say("dark > 0.2", "too many dark pixels", 2, "dark"), _say("over > 0.3", "too many overexposed pixels", 2, "over"),
    _say("season_score < 0.2", "low season score", 3, "season_score"), _say("other_score - season_score > 0.1", "another season fits better", 3, "other_score - season_score"),
)) + ") END"
_PARTS = "greatest(0, least(1, 1 - abs(brightness - 130) / 130 - 0.35 * dark - 0.35 * over)) AS ex, least(1, 0.55 * least(1, edge_density / 0.14) + 0.25 * least(1, contrast / 62) + 0.20 * least(1, saturation / 0.48)) AS inf"
_TOTAL = "CASE WHEN n_frames < 4 THEN 0 ELSE round(0.34 * sharpness + 0.19 * best_sharpness + 0.20 * season_score + 0.10 * ex + 0.09 * inf + 0.05 * du + 0.03 * confidence, 6) END"


@query("scene_evaluation", f"""WITH {_SEASON}, e AS (SELECT *, 0.7 AS confidence, greatest(0, 1 - abs(n_frames - 7) / 7) AS du, {_PARTS} FROM x)
SELECT video_id, scene_idx, {_TOTAL} AS total_score, {_REASONS} AS reasons FROM e""")
def scene_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("video_id", "scene_idx", "total_score", F.array_join("rejection_reasons", " / ").alias("reasons"))


@query("verified_seasons", f"WITH {_SEASON} SELECT video_id, scene_idx, video_id % 3 = 0 AS season_verified, CASE WHEN video_id % 3 = 0 THEN '가을' ELSE detected END AS detected_season, CASE WHEN video_id % 3 = 0 THEN '가을' ELSE expected_season END AS expected_season, CASE WHEN video_id % 3 = 0 THEN s3 ELSE season_score END AS season_score, detected AS auto_detected_season FROM x")
def verified_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evaluated(spark, sf_dir).withColumn("verified_season", F.when(F.col("video_id") % 3 == 0, "가을").when(F.col("video_id") % 3 == 1, "?"))
    return C.verified_override(rows).select("video_id", "scene_idx", "season_verified", "detected_season", "expected_season", "season_score", "auto_detected_season")


@query("centred_windows", f"WITH {SERIES}, {_FRAMES}, sc AS (SELECT DISTINCT video_id, scene_idx, scene_idx * 432000.0 AS a, scene_idx * 432000.0 + 432000 - (video_id % 3) * 200000 AS z FROM f), b AS (SELECT sc.video_id, sc.scene_idx, arg_max(t, {{'s': 0.75 * sharpness + 0.25 * greatest(0, least(1, 1 - abs(brightness - 130) / 130)), 't': -t}}) AS c FROM sc JOIN f ON f.video_id = sc.video_id AND f.scene_idx = sc.scene_idx AND t >= a + 86400 AND t <= z - 86400 GROUP BY 1, 2), w AS (SELECT sc.*, greatest(a, coalesce(c, (a + z) / 2) - 86400) AS w0 FROM sc LEFT JOIN b USING (video_id, scene_idx)) SELECT video_id, scene_idx, CASE WHEN z - a > 172800 THEN greatest(a, least(z, w0 + 172800) - 172800) ELSE a END AS \"start\", CASE WHEN z - a > 172800 THEN least(z, w0 + 172800) ELSE z END AS \"end\" FROM w")
def centred_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    a = F.col("scene_idx") * 432000.0
    scenes = f.select("video_id", "scene_idx").distinct().select("video_id", "scene_idx", a.alias("start"), (a + 432000 - (F.col("video_id") % 3) * 200000).alias("end"))
    return C.centred_window(scenes, f.select("video_id", "scene_idx", "t", "sharpness", "brightness"), ["video_id", "scene_idx"], 172800.0)


# ---- selection: a customer's orders are a video's candidates

_DIGITS = "[(o_orderkey % 7)::DOUBLE, (o_orderkey % 11)::DOUBLE, (o_orderkey % 5)::DOUBLE, (o_orderkey % 3)::DOUBLE]"
_K3 = f"""WITH o AS (SELECT o_custkey AS video_id, o_orderkey AS scene_idx, o_totalprice AS score, {_DIGITS} AS h, CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 4 END AS most FROM orders),
u AS (SELECT video_id, scene_idx, unnest(range(4)) AS i, unnest(h) AS v FROM o), cn AS (SELECT video_id, scene_idx, list(v - mu ORDER BY i) AS c FROM (SELECT *, avg(v) OVER (PARTITION BY video_id, scene_idx) AS mu FROM u) GROUP BY 1, 2),
q AS (SELECT o.video_id, any_value(most) AS most, list({{'k': scene_idx, 'c': c, 's': score}} ORDER BY score DESC, scene_idx) AS items FROM o JOIN cn USING (video_id, scene_idx) GROUP BY 1),
r AS (SELECT video_id, most, items, list_reduce(list_transform(items, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) >= most OR len(list_filter(acc, lambda y: CASE WHEN list_dot_product(y.c, y.c) * list_dot_product(x[1].c, x[1].c) = 0 THEN 0 ELSE list_dot_product(y.c, x[1].c) / (sqrt(list_dot_product(y.c, y.c)) * sqrt(list_dot_product(x[1].c, x[1].c))) END >= 0.9)) > 0 THEN acc ELSE list_concat(acc, x) END, items[:0]) AS chosen FROM q),
e AS (SELECT video_id, most, unnest(items) AS it, chosen FROM r),
t AS (SELECT video_id, it.k AS scene_idx, list_contains(list_transform(chosen, lambda y: y.k), it.k) AS chosen, CASE WHEN list_contains(list_transform(chosen, lambda y: y.k), it.k) THEN NULL WHEN len(list_filter(chosen, lambda y: y.s > it.s OR (y.s = it.s AND y.k < it.k))) >= most THEN 'quota' ELSE 'similar' END AS reason FROM e)
"""


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_custkey") % 2 == 0, "쇼츠").otherwise("youtube")
    h = F.array(*((F.col("o_orderkey") % n).cast("double") for n in (7, 11, 5, 3)))
    rows = o.select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("scene_idx"), F.col("o_totalprice").alias("score"), h.alias("h"), C.quota(kind, 2, 4).alias("most"))
    return C.diverse_top(rows, "video_id", "scene_idx", "score", "h", "most", 0.9)


@query("diverse_selection", _K3 + "SELECT * FROM t")
def diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir)


_K4 = _K3 + ", w AS (SELECT t.*, o_totalprice AS st, row_number() OVER (PARTITION BY video_id, chosen ORDER BY o_totalprice, scene_idx) AS rn FROM t JOIN orders ON o_orderkey = scene_idx), id AS (SELECT *, CASE WHEN chosen THEN video_id || '_SCENE_' || lpad(rn::VARCHAR, greatest(2, length(rn::VARCHAR))::INT, '0') ELSE video_id || '_REJECTED_' || lpad(rn::VARCHAR, greatest(3, length(rn::VARCHAR))::INT, '0') END AS scene_id FROM w) "


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_idx"), F.col("o_totalprice").alias("start"))
    return C.numbered(_selected(spark, sf_dir).join(o, "scene_idx"))


@query("scene_numbers", _K4 + "SELECT video_id, scene_idx, scene_id FROM id")
def scene_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("video_id", "scene_idx", "scene_id")


@query("video_summary", _K3 + "SELECT video_id, count(*) AS candidates, count(*) FILTER (chosen) AS accepted, count(*) FILTER (NOT chosen) AS rejected FROM t GROUP BY 1")
def video_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.video_summary(_selected(spark, sf_dir))


@query("rejected_scenes", _K4 + "SELECT video_id, string_agg(scene_id || ':' || reason, ',' ORDER BY scene_id) AS rejected FROM id WHERE NOT chosen GROUP BY 1")
def rejected_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.rejected_scenes(_numbered(spark, sf_dir))
    return rows.select("video_id", F.array_join(F.transform("rejected", lambda x: F.concat(x["scene_id"], F.lit(":"), x["reason"])), ",").alias("rejected"))


@query("quality_report", _K4 + "SELECT video_id::VARCHAR AS video_id, st AS candidate_start, st + 5 AS candidate_end, chosen AS accepted, scene_idx AS total_score, coalesce(reason, '') || CASE WHEN reason IS NULL THEN 'dim' ELSE ' / dim' END AS rejection_reasons FROM id")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, sf_dir).withColumns({"video_id": F.col("video_id").cast("string"), "end": F.col("start") + 5, "sharpness": F.lit(0.5), "total_score": F.col("scene_idx"), "rejection_reasons": F.array_compact(F.array("reason", F.lit("dim")))})
    return C.quality_report(rows).select("video_id", "candidate_start", "candidate_end", "accepted", "total_score", "rejection_reasons")


_C4 = _C1.rstrip() + f""",
pd AS (SELECT * FROM (SELECT video_id, scene_idx, confidence, "start" + CASE WHEN scene_idx = 0 THEN 0.15 ELSE 600 END AS sa, "end" - CASE WHEN scene_idx = n_scenes - 1 THEN 0.15 ELSE 600 END AS sz FROM c) WHERE sz - sa >= 7200),
w1 AS (SELECT pd.video_id, pd.scene_idx, arg_max(t, {{'s': 0.75 * value + 0.25 * greatest(0, least(1, 1 - abs(value / 2.0 - 130) / 130)), 't': -t}}) AS best FROM pd JOIN s ON s.video_id = pd.video_id AND t >= sa + 172800 AND t <= sz - 172800 GROUP BY 1, 2),
w2 AS (SELECT pd.*, greatest(sa, coalesce(best, (sa + sz) / 2) - 172800) AS w0 FROM pd LEFT JOIN w1 USING (video_id, scene_idx)),
ws AS (SELECT video_id, scene_idx, confidence, CASE WHEN sz - sa > 345600 THEN greatest(sa, least(sz, w0 + 345600) - 345600) ELSE sa END AS "start", CASE WHEN sz - sa > 345600 THEN least(sz, w0 + 345600) ELSE sz END AS "end" FROM w2),
sm AS (SELECT video_id, scene_idx, "start" + ("end" - "start") * (0.08 + 0.84 * j / 5) AS t FROM ws, unnest(range(6)) AS r(j) WHERE "end" > "start"),
fr AS (SELECT video_id, t, max(event_id) AS frame_idx, arg_max(value, event_id) AS value FROM s GROUP BY 1, 2),
f AS (SELECT sm.video_id, sm.scene_idx, fr.frame_idx, fr.value AS sharpness, {_M} FROM sm ASOF JOIN fr ON sm.video_id = fr.video_id AND sm.t >= fr.t),""" + _SEASON.split(f"{_FRAMES},", 1)[1] + f""",
e AS (SELECT x.*, ws."start", ws."end", ws.confidence, greatest(0, least(1, 1 - abs(ws."end" - ws."start" - 7) / 7)) AS du, {_PARTS} FROM x JOIN ws USING (video_id, scene_idx)),
v AS (SELECT video_id, scene_idx, "start", "end", {_TOTAL} AS total_score, {_REASONS} AS why FROM e),
h AS (SELECT *, list_transform(hh, lambda y: y - list_avg(hh)) AS ch FROM (SELECT *, [(floor("start" / 3600) % 7)::DOUBLE, (floor("start" / 3600) % 11)::DOUBLE, (floor("end" / 3600) % 5)::DOUBLE, (floor("end" / 3600) % 3)::DOUBLE] AS hh FROM v WHERE why = '')),
q AS (SELECT video_id, list({{'k': scene_idx, 'c': ch}} ORDER BY total_score DESC, scene_idx) AS items FROM h GROUP BY 1),
o AS (SELECT video_id, items, list_reduce(list_transform(items, lambda y: [y]), lambda acc, y: CASE WHEN len(acc) >= 3 OR len(list_filter(acc, lambda w: CASE WHEN list_dot_product(w.c, w.c) * list_dot_product(y[1].c, y[1].c) = 0 THEN 0 ELSE list_dot_product(w.c, y[1].c) / (sqrt(list_dot_product(w.c, w.c)) * sqrt(list_dot_product(y[1].c, y[1].c))) END >= 0.9)) > 0 THEN acc ELSE list_concat(acc, y) END, items[:0]) AS picked FROM q),
u AS (SELECT video_id, unnest(range(1, len(items) + 1)) AS place, items, picked FROM o),
t AS (SELECT video_id, items[place].k AS scene_idx, list_contains(list_transform(picked, lambda y: y.k), items[place].k) AS chosen, len(list_filter(items[:place - 1], lambda y: list_contains(list_transform(picked, lambda w: w.k), y.k))) AS better FROM u),
r AS (SELECT v.*, coalesce(chosen, false) AS chosen, CASE WHEN why <> '' THEN why WHEN chosen THEN '' WHEN better >= 3 THEN 'quota' ELSE 'similar' END AS reason FROM v LEFT JOIN t USING (video_id, scene_idx)),
nr AS (SELECT *, row_number() OVER (PARTITION BY video_id, chosen ORDER BY "start", scene_idx) AS rn FROM r)
SELECT video_id, scene_idx, CASE WHEN chosen THEN video_id || '_SCENE_' || lpad(rn::VARCHAR, greatest(2, length(rn::VARCHAR))::INT, '0') ELSE video_id || '_REJECTED_' || lpad(rn::VARCHAR, greatest(3, length(rn::VARCHAR))::INT, '0') END AS scene_id,
  round("start", 6) AS "start", round("end", 6) AS "end", total_score, chosen, reason FROM nr
"""


@query("scene_candidates", _C4)
def scene_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline of a video: cuts, padding, windows, sampled frames, scores, quota, diverse choice and numbers."""
    frames = _frames(spark, sf_dir).drop("scene_idx")
    expected = frames.select("video_id").distinct().withColumn("expected", _expected())
    hours = {c: F.floor(F.col(c) / 3600) for c in ("start", "end")}
    histogram = F.array(*((hours[c] % n).cast("double") for c, n in (("start", 7), ("start", 11), ("end", 5), ("end", 3))))
    rows = C.processed_videos(_diffs(spark, sf_dir), frames, _ranges(spark, sf_dir), ["video_id"], "t", RULES, list(METRICS), expected, C.quota(F.lit("youtube"), 2, 3), histogram, 0.9)
    return rows.select("video_id", F.col("scene_idx").cast("long").alias("scene_idx"), "scene_id", S.rounded(F.col("start"), 6).alias("start"), S.rounded(F.col("end"), 6).alias("end"), "total_score", "chosen", F.array_join("rejection_reasons", " / ").alias("reason"))


_SEASONS_SQL = "['봄', '여름', '가을', '겨울']"


@query("quality_report_columns", _K4 + f"SELECT video_id::VARCHAR AS video_id, 'y' || video_id AS youtube_id, NULL::VARCHAR AS drama_title, st AS candidate_start, st + 5 AS candidate_end, chosen AS accepted, scene_idx AS total_score, (scene_idx % 100) / 100.0 AS sharpness_score, {_SEASONS_SQL}[scene_idx % 4 + 1] AS expected_season, (scene_idx % 10) / 10.0 AS season_score, {_SEASONS_SQL}[scene_idx % 3 + 1] AS detected_season, {_SEASONS_SQL}[scene_idx % 2 + 1] AS auto_detected_season, CASE WHEN scene_idx % 3 = 0 THEN '가을' END AS verified_season, scene_idx % 3 = 0 AS season_verified, scene_idx % 2 = 0 AS season_match_required, NULL::VARCHAR AS season_review_note, coalesce(reason, '') || CASE WHEN reason IS NULL THEN 'dim' ELSE ' / dim' END AS rejection_reasons FROM id")
def quality_report_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 17 columns of the report, two of which the scenes do not have."""
    k = F.col("scene_idx")
    season = lambda n: F.get(F.array(*map(F.lit, S.SEASONS)), (k % n).cast("int"))
    more = {"youtube_id": F.concat(F.lit("y"), "video_id"), "end": F.col("start") + 5, "total_score": k, "sharpness": (k % 100) / 100.0, "expected_season": season(4), "season_score": (k % 10) / 10.0, "detected_season": season(3), "auto_detected_season": season(2)}
    more |= {"verified_season": F.when(k % 3 == 0, "가을"), "season_verified": k % 3 == 0, "season_match_required": k % 2 == 0, "rejection_reasons": F.array_compact(F.array("reason", F.lit("dim"))), "video_id": F.col("video_id").cast("string")}
    return C.quality_report(_numbered(spark, sf_dir).withColumns(more))


# ---- manual segments and ranges


@query("segment_gaps", f"WITH {SERIES}, g AS (SELECT video_id, lag(event_id) OVER w AS before, event_id AS after, t - lag(t + value * 60) OVER w AS d FROM s WINDOW w AS (PARTITION BY video_id ORDER BY t, event_id)) SELECT video_id, before::VARCHAR AS before, after::VARCHAR AS after, CASE WHEN d > 0 THEN 'gap' ELSE 'overlap' END AS kind, round(abs(d), 3) AS seconds FROM g WHERE abs(d) > 0.01")
def segment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = series(spark, sf_dir)
    return G.gaps_and_overlaps(e.select("video_id", F.col("event_id").cast("string").alias("segment_id"), F.col("event_id").alias("item_idx"), F.col("t").alias("start_time"), (F.col("t") + F.col("value") * 60).alias("end_time")))


@query("manual_segments", "WITH e AS (SELECT event_id, user_id, value, CASE WHEN event_id % 5 = 1 THEN -value ELSE value END AS a, CASE WHEN event_id % 5 = 2 THEN value - 1 ELSE value + 4.25 END AS z, CASE WHEN event_id % 5 = 3 THEN value + 50 END AS r FROM events), n AS (SELECT *, concat_ws('; ', CASE WHEN event_id % 5 = 4 THEN 'missing source_filename' END, CASE WHEN a < 0 THEN 'negative start_time' END, CASE WHEN a >= z THEN 'start_time is not before end_time' END, CASE WHEN z > 400.1 THEN 'end_time is after the video' END, CASE WHEN NOT (a <= r AND r < z) THEN 'representative frame is outside' END) AS notes FROM e) SELECT event_id::VARCHAR AS segment_id, round(z - a, 3) AS duration_time, round(coalesce(r, (a + z) / 2), 3) AS representative_frame_time, notes = '' AS time_verified, CASE WHEN notes = '' THEN 'needs_review' ELSE 'needs_time_fix' END AS review_status, notes FROM n")
def manual_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
    v = F.col("value")
    rows = e.select(F.col("event_id").cast("string").alias("segment_id"), F.col("user_id").cast("string").alias("video_id"), F.when(k == 4, " ").otherwise("f.mp4").alias("source_filename"), F.when(k == 1, -v).otherwise(v).alias("start_time"), F.when(k == 2, v - 1).otherwise(v + 4.25).alias("end_time"), F.when(k == 3, v + 50).alias("representative_frame_time"))
    durations = e.select(F.col("user_id").cast("string").alias("video_id")).distinct().withColumn("duration", F.lit(400.0))
    return G.manual_segments(rows, durations).select("segment_id", "duration_time", "representative_frame_time", "time_verified", "review_status", "notes")


@query("clipped_ranges", "SELECT event_id, CASE WHEN value > 100 THEN least(200, value) - 100 ELSE 200 END AS total, CASE WHEN value > 100 THEN 100.0 ELSE 0.0 END AS first FROM events")
def clipped_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda a, b: F.struct(a.alias("start_time"), b.alias("end_time"))
    ranges = C.ranges_of(F.array(pair(F.lit(100.0), F.col("value")), pair(F.lit(300.0), F.lit(400.0)), pair(F.lit(-5.0), F.lit(0.0))), F.lit(200.0))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(ranges).alias("r"))
    return rows.groupBy("event_id").agg(F.sum(F.col("r.end_time") - F.col("r.start_time")).alias("total"), F.min("r.start_time").alias("first"))


# ---- pixels: a user's events laid out in rows of 16

_PX = "px AS (SELECT user_id AS frame_id, (row_number() OVER w - 1) % 16 AS x, (row_number() OVER w - 1) // 16 AS y, floor(value * 7)::INT % 180 AS h, floor(value * 13)::INT % 256 AS s, floor(value * 29)::INT % 256 AS v, floor(value * 31)::INT % 256 AS gray FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    v = lambda k, m: F.floor(F.col("value") * k).cast("int") % m
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("frame_id"), (n % 16).alias("x"), F.floor(n / 16).alias("y"), v(7, 180).alias("h"), v(13, 256).alias("s"), v(29, 256).alias("v"), v(31, 256).alias("gray"))


@query("mask_ratios", f"WITH {_PX}, hh AS (SELECT *, max(y) OVER (PARTITION BY frame_id) + 1 AS rows FROM px) SELECT frame_id, round(avg((h BETWEEN 30 AND 90 AND s >= 55 AND v >= 45)::INT), 6) AS green, round(avg((h BETWEEN 18 AND 35 AND s >= 60 AND v >= 80)::INT), 6) AS yellow, round(avg(((h >= 145 OR h <= 8) AND s BETWEEN 25 AND 175 AND v >= 125)::INT), 6) AS pink, round(avg(((h <= 20 OR h >= 165) AND s >= 55 AND v >= 45)::INT), 6) AS warm, round(avg((h BETWEEN 5 AND 28 AND s BETWEEN 40 AND 210 AND v BETWEEN 35 AND 185)::INT), 6) AS brown, round(avg((h BETWEEN 90 AND 132 AND s >= 48 AND v >= 55)::INT), 6) AS blue, round(avg((s <= 45 AND v >= 175)::INT), 6) AS white, round(avg((s <= 48)::INT), 6) AS low_saturation, round(avg((s <= 45 AND v >= 175)::INT) FILTER (y < greatest(1, floor(0.72 * rows))), 6) AS white_upper, round(avg((s <= 45 AND v >= 175)::INT) FILTER (y >= floor(0.40 * rows)), 6) AS white_lower FROM hh GROUP BY 1")
def mask_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.mask_ratios(_pixels(spark, sf_dir))
    return rows.select("frame_id", *(F.round(c, 6).alias(c) for c in rows.columns if c != "frame_id"))


@query("frame_exposure", f"WITH {_PX} SELECT frame_id, round(avg(gray), 6) AS brightness, round(stddev_pop(gray), 6) AS contrast, round(avg(s) / 255, 6) AS saturation, round(avg((gray < 25)::INT), 6) AS dark, round(avg((gray > 245)::INT), 6) AS over FROM px GROUP BY 1")
def frame_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.exposure(_pixels(spark, sf_dir))
    return rows.select("frame_id", *(F.round(c, 6).alias(c) for c in rows.columns if c != "frame_id"))


@query("colour_histograms", f"WITH {_PX}, b AS (SELECT frame_id, (least(floor(h / 7.5), 23) * 16 + least(floor(s / 16), 15))::INT AS bin, count(*)::DOUBLE AS n FROM px GROUP BY 1, 2), l AS (SELECT frame_id, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1) SELECT frame_id, bin, round(n / norm, 6) AS weight FROM b JOIN l USING (frame_id)")
def colour_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.colour_histogram(_pixels(spark, sf_dir)).select("frame_id", F.posexplode("histogram").alias("bin", "weight"))
    return rows.filter("weight > 0").select("frame_id", "bin", F.round("weight", 6).alias("weight"))


_ST = f"""WITH {_PX}, a AS (SELECT frame_id, x, y, gray::DOUBLE AS g, coalesce(lag(gray) OVER r, lead(gray) OVER r, gray) AS l, coalesce(lead(gray) OVER r, lag(gray) OVER r, gray) AS rr FROM px WINDOW r AS (PARTITION BY frame_id, y ORDER BY x)),
b AS (SELECT *, rr - l AS dx, l + 2 * g + rr AS sx FROM a), c AS (SELECT *, coalesce(lag(g) OVER k, lead(g) OVER k, g) AS u, coalesce(lead(g) OVER k, lag(g) OVER k, g) AS d, coalesce(lag(dx) OVER k, lead(dx) OVER k, dx) AS du, coalesce(lead(dx) OVER k, lag(dx) OVER k, dx) AS dd, coalesce(lag(sx) OVER k, lead(sx) OVER k, sx) AS su, coalesce(lead(sx) OVER k, lag(sx) OVER k, sx) AS sd FROM b WINDOW k AS (PARTITION BY frame_id, x ORDER BY y)),
e AS (SELECT frame_id, var_pop(l + rr + u + d - 4 * g) AS laplacian, avg((du + 2 * dx + dd) ** 2 + (sd - su) ** 2) AS tenengrad FROM c GROUP BY 1)
SELECT frame_id, round(laplacian, 4) AS laplacian, round(tenengrad, 4) AS tenengrad, round(0.62 * greatest(0, least(1, (ln(1 + laplacian) - ln(36)) / (ln(1201) - ln(36)))) + 0.38 * greatest(0, least(1, (ln(1 + tenengrad) - ln(181)) / (ln(8001) - ln(181)))), 6) AS sharpness FROM e"""


@query("frame_sharpness", _ST)
def frame_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.stencils(_pixels(spark, sf_dir)).select("frame_id", F.round("laplacian", 4).alias("laplacian"), F.round("tenengrad", 4).alias("tenengrad"), F.round("sharpness", 6).alias("sharpness"))
