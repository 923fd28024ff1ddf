"""Unit and property tests of the scene, search, table and text operators."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel import plans
from lumenreel.functions import scores as S_
from lumenreel.functions import text as T
from lumenreel.functions import vectors as V
from lumenreel.operators import frames as X
from lumenreel.operators import index
from lumenreel.operators import scenes as C
from lumenreel.operators import search as S
from lumenreel.operators import segments as G
from lumenreel.operators import tables as K
from lumenreel.operators import tagging
from lumenreel.operators.encoders import Encoder
from lumenreel.sources import arrays, io, store
from lumenreel.streaming import incremental, records


def one(spark, expr, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(expr).first()[0]


# ---- texts


def test_search_text(spark):
    item = {"spot_name": F.lit(" Beach "), "place_name": F.lit("unknown"), "region": F.lit("Gangneung"), "drama_title": F.lit("Title"), "season": F.lit("winter"), "time_of_day": F.lit("day"), "description": F.lit("Sea."), "mood": F.array(*map(F.lit, ["calm", "Calm", "UNKNOWN", "a", "b", "c", "d", "e"]))}
    assert one(spark, T.search_text(item)) == "Beach. Gangneung. Title. winter day. Sea.. Mood: calm, a, b, c, d"
    assert one(spark, T.search_text({})) == ""


@pytest.mark.parametrize(("path", "stem"), [("keyframes/HCCC_01/HCCC_01_SCENE_02.jpg", "HCCC_01_SCENE_02"), ("a/.hidden", ".hidden"), ("x.tar.gz", "x.tar"), ("noext", "noext")])
def test_keyframe_id(spark, path, stem):
    assert one(spark, T.keyframe_id(F.lit("V005_P010_S001"), F.lit(path))) == f"V005_P010_S001__{stem}"


@pytest.mark.parametrize(("seconds", "code"), [(4.63, "00:00:04.630"), (9.97, "00:00:09.970"), (3661.0005, "01:01:01.000"), (0.0, "00:00:00.000"), (360000.25, "100:00:00.250")])
def test_timecode(spark, seconds, code):
    assert one(spark, T.timecode(F.lit(seconds))) == code


def test_cleaning(spark):
    assert one(spark, T.hangul_only(F.lit("서울　타워! abc 3층"))) == "서울 타워 3층"
    assert one(spark, T.hangul_only(F.lit(None).cast("string"))) == ""
    assert one(spark, T.safe_name(F.lit("__서울 tower/é__"))) == "서울_tower_é" and one(spark, T.safe_name(F.lit("///"))) == "video"
    assert one(spark, T.text_or_null(F.lit(" UNKNOWN "))) is None
    assert one(spark, T.unique_strings(F.lit(None).cast("array<string>"))) == []


def test_unique_strings_whole_texts(spark, tmp_path):
    """The query looks at every word, not only the first ones."""
    r = random.Random(3)
    texts = [None, "", "b A a unknown B", *(" ".join(r.choice([f"w{k}", f"W{k}", "UnKnown"]) for k in (r.randrange(400) for _ in range(n))) for n in (39, 40, 41, 300, 900))]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.turn: (x.folded, x.exact) for x in plans.registry()["unique_strings"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts[1:], 1):
        words, seen = [w for w in t.split() if w.lower() != "unknown"], {}
        for w in words:
            seen.setdefault(w.lower(), w)
        assert got[i] == ("|".join(seen.values()), len(set(words)))


# ---- vectors and search


def test_vector_checks(spark):
    ok = lambda x: one(spark, V.is_vector(x, 2))
    assert ok(F.array(F.lit(1.0), F.lit(2.0))) and not ok(F.array(F.lit(1.0))) and not ok(F.array(F.lit(float("nan")), F.lit(1.0))) and not ok(F.array(F.lit(float("inf")), F.lit(1.0)))
    assert not ok(F.lit(None).cast("array<double>")) and not ok(F.array(F.lit(None).cast("double"), F.lit(1.0)))
    assert [round(1 - d, 2) for d in (0, 0.25, 1)] == [1, 0.75, 0]
    for bad in ({"k": 0}, {"k": True}, {"mode": "sound"}, {"query": [0.0, 0.0]}, {"query": [math.nan, 1.0]}, {"query": [1.0], "dimension": 2}):
        with pytest.raises(ValueError):
            S.check_arguments(**({"query": [1.0, 2.0], "mode": "text", "k": 3, "dimension": None} | bad))
    with pytest.raises(Exception, match="zero vector"):
        one(spark, V.normalised(F.array(F.lit(0.0)), None))


def test_search_brute_force(spark):
    r = np.random.default_rng(1)
    seg = [(f"s{i}", f"r{i % 2}") for i in range(12)]
    text = [(s, r.normal(size=8).tolist()) for s, _ in seg if s != "s3"]
    frames = [(f"k{i}", f"s{i % 11}", f"d{i}") for i in range(40)]
    image = [(k, r.normal(size=8).tolist() if k != "k5" else [0.0] * 8) for k, *_ in frames if k != "k7"]
    q = r.normal(size=8).tolist()
    cos = lambda a: float(np.dot(a, q) / np.linalg.norm(a) / np.linalg.norm(q)) if any(a) else None
    ts, im = {s: cos(v) for s, v in text}, {k: cos(v) for k, v in image}
    best = {}
    for k, s, _ in frames:
        if im.get(k) is not None and (s not in best or (-im[k], k) < best[s][0]):
            best[s] = ((-im[k], k), k)
    able = [s for s, _ in seg if s in ts and s in best]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = (df(seg, "segment_id string, region string"), df(text, "segment_id string, text_embedding array<double>"), df(frames, "keyframe_id string, segment_id string, description string"), df(image, "keyframe_id string, image_embedding array<double>"))
    for mode in S.MODES:
        score = (lambda s: ts[s]) if mode == "text" else (lambda s: -best[s][0][0])
        want = sorted(able, key=lambda s: (-score(s), s))[:5]
        got = S.search(*tables, q, mode, 5)
        assert got.columns == [c for c, _ in S.RESULT] and len(got.columns) == 19
        rows = got.collect()
        assert [x.segment_id for x in rows] == want
        assert all(x.keyframe_id == best[x.segment_id][1] and x.description == "d" + x.keyframe_id[1:] and abs(x.similarity - score(x.segment_id)) < 1e-9 for x in rows)


def test_nearest_of_many_without_queries(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert S.nearest_of_many(e, e.limit(0), "embedding", "vec_id", 3).count() == 0


def _recall_and_share(spark, e, folder):
    """Every row is indexed; queries are all rows whose id is a multiple of 50, against all rows."""
    model = index.build(e, "embedding", "vec_id", folder)
    queries = e.filter("vec_id % 50 = 0")
    pairs = lambda rows: {(x.query_id, x.vec_id) for x in rows.collect()}
    exact, found = pairs(S.nearest_of_many(e, queries, "embedding", "vec_id", 10)), pairs(index.search(folder, queries, "embedding", "vec_id", 10))
    size = {x.list: x["count"] for x in spark.read.parquet(f"{folder}/rows").groupBy("list").count().collect()}
    assert sum(size.values()) == e.count() and len(size) > 0.7 * e.count() ** 0.5
    q = np.array([x.embedding for x in queries.collect()], np.float64)
    looked = [sum(size.get(c, 0) for c in row) for row in model.nearest(q, model.probes)]
    return len(exact & found) / len(exact), np.mean(looked) / e.count()


def _clustered(n, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(80, 64))
    return [(i, [float(x) for x in np.float32(centres[i % 80] + 0.3 * r.normal(size=64))]) for i in range(n)]


def test_approximate_search_prunes_and_recalls(spark, tmp_path):
    recall, share = _recall_and_share(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), f"{tmp_path}/a")
    assert recall >= 0.9 and share < 0.9  # independent directions: near neighbours are in most lists
    recall, share = _recall_and_share(spark, spark.createDataFrame(_clustered(2000), "vec_id long, embedding array<float>"), f"{tmp_path}/b")
    assert recall >= 0.95 and share < 0.15


def test_index_insertion(spark, tmp_path, monkeypatch):
    """Inserted rows are found as if they had been there at once; lists of many rows are searched in shards."""
    rows = _clustered(1200) + [(5000 + i, _clustered(1)[0][1]) for i in range(300)]  # the last ones all in one list
    df = spark.createDataFrame([*rows, (9000, None), (9001, [0.0] * 64), (9002, [1.0])], "vec_id long, embedding array<float>")
    index.build(df.filter("vec_id < 600"), "embedding", "vec_id", str(tmp_path / "i"))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("i/rows/list=*/*.parquet")}
    index.insert(df.filter("vec_id >= 600"), "embedding", "vec_id", str(tmp_path / "i"))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # nothing is written anew
    queries = df.filter("vec_id % 50 = 0")
    for block in (S.ROW_BLOCK, 100):
        monkeypatch.setattr(S, "ROW_BLOCK", block)
        monkeypatch.setattr(S, "QUERY_BLOCK", 4096 if block > 100 else 7)
        exact, found = ({(x.query_id, x.vec_id) for x in rows.collect()} for rows in (S.nearest_of_many(df, queries, "embedding", "vec_id", 5), index.search(str(tmp_path / "i"), queries, "embedding", "vec_id", 5, most=400)))
        assert len(exact & found) >= 0.97 * len(exact) and any(v >= 600 for _, v in found)


def test_index_reads_only_probed_lists(spark, tmp_path):
    folder = str(tmp_path / "i")
    df = spark.createDataFrame(_clustered(1500), "vec_id long, embedding array<float>")
    model = index.build(df, "embedding", "vec_id", folder)
    one = df.filter("vec_id = 50").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    near = index.candidates(index._rows(spark, folder, "bigint", "array<float>"), one, model, 2, 20)
    plan = near._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan.replace("cast(", "") or "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "vector" not in [x for x in plan.split("ReadSchema: ")[1:] if "code" in x][0].split("\n")[0]
    assert {r.list for r in near.select("list").distinct().collect()} <= set(model.nearest(np.array([one.first().v]), 2)[0].tolist())


def test_many_queries_scan_the_corpus_once(spark, tmp_path):
    """20,000 queries in five blocks: one scan of the corpus, and no vectors on the driver (no broadcast)."""
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(8).normal(size=(20_000, 4)).round(3))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/queries")
    spark.createDataFrame(rows[:900], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/corpus")
    found = S.nearest_of_many(spark.read.parquet(f"{tmp_path}/corpus"), spark.read.parquet(f"{tmp_path}/queries"), "embedding", "vec_id", 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) == 2 and "Broadcast" not in plan
    got = {(x.query_id, x["rank"]): x.vec_id for x in found.collect()}
    x = np.array([v for _, v in rows[:900]], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 40_000
    for i in range(0, 20_000, 997):
        q = np.array(rows[i][1], np.float32).astype(np.float64)
        d = sorted((round(1 - float(q @ v / np.linalg.norm(q)), 11), n) for n, v in enumerate(x))
        assert [got[i, 1], got[i, 2]] == [n for _, n in d[:2]]


def test_nearest_of_many_blocks_and_odd_vectors(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(f"v{i:03}", r.normal(size=4).round(1).tolist()) for i in range(200)] + [("z", [0.0] * 4), ("n", None), ("x", [float("nan"), 1.0, 1.0, 1.0]), ("s", [1.0]), (None, [1.0] * 4)]
    rows += [(f"w{i:03}", rows[i][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "name string, v array<double>")
    good = [(k, np.array(v)) for k, v in rows if k is not None and v is not None and len(v) == 4 and any(v) and not np.isnan(v).any()]
    for block in (2048, 40):
        monkeypatch.setattr(S, "QUERY_BLOCK", block)
        monkeypatch.setattr(S, "ROW_BLOCK", 2 * block)
        got = {(x.query_id, x["rank"]): x.name for x in S.nearest_of_many(df, df.orderBy("name"), "v", "name", 3).collect()}
        assert len(got) == 3 * len(good)
        for k, q in good:
            d = sorted((round(1 - float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 11), n) for n, v in good)
            assert [got[k, i] for i in (1, 2, 3)] == [n for _, n in d[:3]]


# ---- scenes


@pytest.mark.parametrize("density", [50, 12])
def test_spaced_property(spark, density):
    """Run by run as over a whole range at once, with ties; no run is longer than where the peaks are dense."""
    r = random.Random(density)
    data = {v: [(round(r.random(), 1), round(r.uniform(0, density * 4), 1)) for _ in range(r.randrange(0, 60))] for v in range(12)}
    found = spark.createDataFrame([(v, 0, t, c) for v, items in data.items() for c, t in items], "v int, r int, t double, confidence double")
    ranges = spark.createDataFrame([(v, 0, 1.0 * (v % 3), 300.0) for v in data], "v int, r int, start double, end double")
    got = C.spaced_peaks(found, ranges, ["v", "r"], "t", 3.0).collect()
    for v, items in data.items():
        want = [1.0 * (v % 3)]
        for _, t in sorted(items, key=lambda x: (-x[0], x[1])):
            if all(abs(t - b) >= 3.0 for b in want):
                want.append(t)
        assert sorted(x.t for x in got if x.v == v) == sorted(want[1:])
        assert all((x.confidence, x.t) in items for x in got if x.v == v)


def test_intervals(spark):
    chosen = spark.createDataFrame([("a", 3.0, 0.9), ("a", 9.5, 0.6), ("b", 4.0, None)], "v string, t double, confidence double")
    ranges = spark.createDataFrame([("a", 0.0, 10.0), ("b", 1.0, 5.0), ("c", 0.0, 1.0)], "v string, start double, end double")
    got = sorted((x.v, x.scene_idx, x.n_scenes, x.start, x.end, round(x.confidence, 3)) for x in C.intervals(chosen, ranges, ["v"]).collect())
    assert got == [("a", 0, 2, 0.0, 3.0, 0.8), ("a", 1, 2, 3.0, 10.0, 0.8), ("b", 0, 2, 1.0, 4.0, 0.725), ("b", 1, 2, 4.0, 5.0, 0.725), ("c", 0, 1, 0.0, 1.0, 0.7)]


@pytest.mark.parametrize("hot", [1_000_000, 20, 0])
def test_medians(spark, hot):
    """Exact whichever way a group goes, with ties, nulls, one value, and null keys."""
    r = random.Random(hot)
    groups = {("a", 1): [round(r.gauss(0, 3), r.choice([0, 3])) for _ in range(501)], ("a", 2): [r.random() for _ in range(40)], ("b", None): [2.0] * 30 + [None] * 5, (None, 1): [1.0, 4.0], ("c", 0): [7.5], ("d", 1): [None]}
    df = spark.createDataFrame([(*k, v) for k, values in groups.items() for v in values], "k string, j int, v double").repartition(5)
    got = {(x.k, x.j): (x.n, x.med) for x in C.medians(df, ["k", "j"], "v", C.hot_groups(df, ["k", "j"], hot)).collect()}
    for k, values in groups.items():
        some = [v for v in values if v is not None]
        assert got[k] == (len(values), np.median(some) if some else None), k


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0])
def test_as_of_property(spark, width):
    """Buckets change nothing: ties go to the last by the tie column, buckets without rows are passed over."""
    r = random.Random(6)
    right = [(v, round(r.uniform(0, 60), 1), i, r.choice([None, "x", "y"])) for v in ("a", "b") for i in range(80)] + [("a", None, 900, "z")]
    left = [(v, round(r.uniform(-5, 90), 1), i) for v in ("a", "b", "none") for i in range(60)] + [("a", None, 99)]
    x = spark.createDataFrame(left, "v string, t double, id int")
    y = spark.createDataFrame(right, "v string, t double, frame int, note string")
    got = {(g.v, g.id): (g.frame, g.note) for g in C.as_of(x, y, ["v"], "t", ["frame", "note"], tie=["frame"], width=width).collect()}
    assert len(got) == len(left)
    for v, t, i in left:
        before = [(s, f, n) for w, s, f, n in right if w == v and s is not None and t is not None and s <= t]
        assert got[v, i] == (max(before)[1:] if before else (None, None))


def test_as_of_spreads_a_long_video(spark):
    """One video with most of the frames: its rows are ordered in many tasks."""
    frames = spark.range(40_000).select(F.lit("v").alias("v"), (F.col("id") / 4).alias("t"), F.col("id").alias("frame"))
    wanted = spark.range(2000).select(F.lit("v").alias("v"), (F.col("id") * 5 + 0.1).alias("t"))
    got = C.as_of(wanted, frames, ["v"], "t", ["frame"], width=50.0)
    assert got.agg(F.sum("frame"), F.count("*")).first() == (sum(20 * i for i in range(2000)), 2000)
    window = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in x][0]
    assert "_b#" in window.split("], [")[1]
    rows = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(rows) > 1


def test_diverse_top_property(spark):
    r = random.Random(3)
    rows = [(g, i, round(r.random(), 3), [r.random() for _ in range(6)], 3) for g in range(4) for i in range(15)]
    df = spark.createDataFrame(rows, "g int, k int, score double, h array<double>, most int")
    got = {(x.g, x.k): (x.chosen, x.reason) for x in C.diverse_top(df, "g", "k", "score", "h", "most", 0.5).collect()}
    assert len(got) == len(rows)
    for g in range(4):
        picked = []
        for _, k, _, h, _ in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1])):
            if len(picked) >= 3:
                want = (False, "quota")
            elif any(np.corrcoef(h, p)[0, 1] >= 0.5 for p in picked):
                want = (False, "similar")
            else:
                want = (True, None)
                picked.append(h)
            assert got[g, k] == want


def test_short_series_is_one_scene(spark):
    d = spark.createDataFrame([("v", 1.0, 0.9), ("v", 2.0, 0.1)], "video_id string, t double, diff double")
    ranges = spark.createDataFrame([("v", 0.0, 10.0), ("w", 0.0, 5.0)], "video_id string, start double, end double")
    rules = {"base_cut_threshold": 0.3, "adaptive_mad_multiplier": 3.0, "minimum_cut_gap_seconds": 1.0}
    scenes, thresholds = C.detect_scenes(d, ranges, ["video_id"], "t", rules)
    assert sorted((x.video_id, x.start, x.end) for x in scenes.collect()) == [("v", 0.0, 10.0), ("w", 0.0, 5.0)]
    assert thresholds.first().threshold == 0.3


def test_ranges(spark):
    pair = lambda a, b: F.struct(F.lit(a).alias("start_time"), F.lit(b).alias("end_time"))
    got = one(spark, C.ranges_of(F.array(pair(-1.0, 3.0), pair(8.0, 7.0), pair(9.0, 20.0)), F.lit(10.0)))
    assert [tuple(x) for x in got] == [(0.0, 3.0), (9.0, 10.0)]
    assert [tuple(x) for x in one(spark, C.ranges_of(F.lit(None), F.lit(10.0)))] == [(0.0, 10.0)]


def test_several_ranges_of_a_video(spark):
    """Two ranges a video: unique scenes, numbers over the whole video, and its quota held."""
    frames = spark.range(2400).select((F.col("id") % 3).cast("string").alias("video_id"), (F.floor(F.col("id") / 3) / 2).alias("t"), F.col("id").alias("frame_idx"), (F.abs(F.hash("id")) % 97 + 1.0).alias("sharpness"))
    metrics = list(dict.fromkeys([*S_.SEASON_SCALES, "brightness", "contrast", "dark", "over", "edge_density", "saturation"]))
    frames = frames.withColumns({m: (F.abs(F.hash("frame_idx", F.lit(m))) % 100) / 100.0 for m in metrics})
    pair = lambda a, b: F.struct(F.lit(a).alias("start_time"), F.lit(b).alias("end_time"))
    videos = spark.createDataFrame([("0",), ("1",), ("2",)], "video_id string").withColumns({"candidate_ranges": F.array(pair(-5.0, 180.0), pair(150.0, 390.0), pair(500.0, 900.0)), "duration": F.lit(395.0)})
    ranges = C.video_ranges(videos)
    assert sorted(map(tuple, ranges.filter("video_id = '1'").collect())) == [("1", 0, 0.0, 180.0), ("1", 1, 150.0, 390.0)]
    keys = ["video_id", "range_idx"]
    mine = C.in_ranges(frames, ranges, "video_id", "t")
    assert mine.filter("video_id = '1'").count() == 361 + 481
    w = W.partitionBy(*keys).orderBy("t")
    diffs = mine.select(*keys, "t", (F.abs(F.col("sharpness") - F.lag("sharpness").over(w)) / 97).alias("diff")).filter("diff is not null")
    rules = {"base_cut_threshold": 0.3, "adaptive_mad_multiplier": 1.0, "minimum_cut_gap_seconds": 6.0, "transition_padding_seconds": 0.5, "minimum_scene_seconds": 2.0, "maximum_scene_seconds": 9.0, "sample_frames_per_scene": 6, "minimum_median_sharpness": 10.0, "minimum_best_frame_sharpness": 20.0, "maximum_blurry_frame_ratio": 0.9, "minimum_brightness": 0.0, "maximum_brightness": 1.0, "maximum_dark_pixel_ratio": 1.0, "maximum_overexposed_pixel_ratio": 1.0, "minimum_expected_season_score": 0.0, "maximum_other_season_advantage": 1.0}
    expected = videos.select("video_id", F.array().cast("array<string>").alias("expected"))
    rows = C.processed_videos(diffs, mine, ranges, keys, "t", rules, metrics, expected, F.lit(3), F.array("sharpness", "brightness", "contrast", "start"), 0.999).collect()
    scenes = [(x.video_id, x.range_idx, x.scene_idx) for x in rows]
    assert len(scenes) == len(set(scenes)) == C.scene_candidates(diffs, mine, ranges, keys, "t", rules, metrics, expected).count() > 40
    assert {x.range_idx for x in rows} == {0, 1} and len({x.scene_id for x in rows}) == len(rows)
    for v in "012":
        chosen = sorted((x for x in rows if x.video_id == v and x.chosen), key=lambda x: x.scene_id)
        assert len(chosen) == 3 and [x.scene_id for x in chosen] == [f"{v}_SCENE_0{i}" for i in (1, 2, 3)]
        assert [x.start for x in chosen] == sorted(x.start for x in chosen)
        worst = min(x.total_score for x in chosen)
        assert all(x.total_score <= worst or "similar" in x.rejection_reasons for x in rows if x.video_id == v and x.accepted and not x.chosen)


def test_overlap_of_very_different_lengths(spark):
    """All touching pairs once, and few copies of an interval a million cells long."""
    r = random.Random(9)
    spans = lambda n: [("v" if r.random() < 0.8 else "w", i, (s := round(r.uniform(0, 5000), 1)), s + r.choice([0.0, 0.5, 3.0, 40.0, 900.0, 1_000_000.0])) for i in range(n)]
    x, y = spans(60), spans(70)
    a = spark.createDataFrame(x, "v string, id int, start double, end double")
    b = spark.createDataFrame(y, "v string, no int, start double, end double")
    rows = C.overlapping(a, b, "v", 1.0)
    got = sorted((z.id, z.no) for z in rows.select("x.id", "y.no").collect())
    assert got == sorted((i, k) for v, i, s, e in x for w, k, p, q in y if v == w and p <= e and q >= s)
    copies = rows.select("x.id", "x._size", "x._cell").distinct().groupBy("id").count().agg(F.max("count")).first()[0]
    assert copies <= 2 * 21


def test_overlap_counts_each_pair_once(spark):
    a = spark.createDataFrame([("v", 1, 0.0, 100.0)], "video_id string, id int, start double, end double")
    b = spark.createDataFrame([("v", float(i), float(i + 40)) for i in range(0, 100, 10)], "video_id string, start double, end double")
    assert C.overlapping(a, b, "video_id", 7.0).count() == 10


# ---- tables, records, stores, streams


def _items(spark):
    rows = [(0, "SEG001", "VIDEO01", "keyframes/A/A_01.jpg", "first"), (1, "SEG001", "VIDEO01", "keyframes/A/A_02.jpg", "second"), (2, "SEG002", "VIDEO02", "keyframes/B/B_01.jpg", "third")]
    return spark.createDataFrame(rows, "item_idx long, segment_id string, video_id string, keyframe_path string, description string")


def test_records(spark):
    items = _items(spark)
    encode = lambda texts: [[0.1] * 512 for _ in texts]
    segments, frames = G.embedding_records(items, {"description": "description"}, encode, encode, 512)
    assert (segments.count(), frames.count(), frames.select("keyframe_id").distinct().count()) == (2, 3, 3)
    assert segments.filter("segment_id = 'SEG001'").first().search_text == "first. second"
    s, k = G.prepared_records(items, segments, frames, 512)
    assert {x.segment_id: x.description for x in s.collect()} == {"SEG001": "first", "SEG002": "third"} and k.count() == 3
    with pytest.raises(ValueError, match="missing_in_b"):
        G.prepared_records(items, segments.limit(1), frames, 512)
    with pytest.raises(ValueError, match="belongs to"):
        G.prepared_records(items, segments, frames.withColumn("segment_id", F.lit("SEG001")), 512)
    with pytest.raises(ValueError, match="finite"):
        G.prepared_records(items, segments, frames, 64)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "k int, v string, made string")
    new = spark.createDataFrame([(2, "c", "y"), (3, None, "y")], "k int, v string, made string")
    once = K.upsert(old, new, "k", ["v"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x"), (2, "c", "x"), (3, None, "y")]
    assert sorted(map(tuple, K.upsert(once, new, "k", ["v"]).collect())) == sorted(map(tuple, once.collect()))


def test_upsert_keys_and_columns(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1, "n"), (2, "d", 2, "m")], "k int, v string, at int, more string")
    assert sorted(map(tuple, K.upsert(old, new, "k", ["v"], "at").collect())) == [(1, "a", None, None), (2, "d", 2, "m")]
    with pytest.raises(Exception, match="repeated"):
        K.upsert(old, new, "k", ["v"]).collect()
    with pytest.raises(Exception, match="without k"):
        K.upsert(old, spark.createDataFrame([(None, "c")], "k int, v string"), "k", ["v"]).collect()
    with pytest.raises(ValueError, match="video_segments"):
        store.load(spark, "/nowhere", {})


def test_deleting_a_video_cascades(spark):
    t = {
        "videos": spark.createDataFrame([("v",), ("w",)], "video_id string"),
        "video_segments": spark.createDataFrame([("s", "v"), ("t", "w")], "segment_id string, video_id string"),
        "segment_keyframes": spark.createDataFrame([("k", "s"), ("l", "t")], "keyframe_id string, segment_id string"),
        "keyframe_embeddings": spark.createDataFrame([("k",), ("l",)], "keyframe_id string"),
    }
    out = store.deleted(t, "videos", spark.createDataFrame([("v",)], "video_id string"))
    assert {n: [x[0] for x in rows.collect()] for n, rows in out.items()} == {"videos": ["w"], "video_segments": ["t"], "segment_keyframes": ["l"], "keyframe_embeddings": ["l"]}


def test_validation_looks_at_the_top_level(spark):
    items = ['{"extra": {"segment_id": "a", "description": "b"}, "video_id": "v", "spot_name": "p", "keyframe_path": "k", "start_time": 1, "end_time": 2.5}', '"text"', "null", '{"segment_id": 5, "video_id": null, "spot_name": null, "keyframe_path": "k", "start_time": "1", "end_time": 1, "description": " ", "mood": null, "activity": ["a", "a"]}']
    raw = spark.createDataFrame(list(enumerate(items)), "item_idx int, t string").select("item_idx", F.parse_json("t").alias("item"))
    got = {x.item_idx: (x.errors, x.warnings) for x in G.validated_metadata(raw).collect()}
    assert got[0] == (["missing segment_id", "missing description"], []) and got[1] == got[2] == (["not an object"], [])
    assert got[3] == (["blank segment_id", "blank description", "start_time is not a number", "mood is not a list"], ["repeated values in activity"])


def test_tags_fall_back_as_a_whole(spark):
    seg = spark.createDataFrame([(str(i), "y", 0.0, 1.0, "t", p, "r") for i, p in enumerate(["남산 tower", "남산", "", "tower", "강"])], "segment_id string, youtube_id string, start double, end double, drama_title string, place_name string, region string")
    captions = spark.createDataFrame([], "youtube_id string, start double, duration double, text string")

    def annotate(title, place, region, script):
        return {"남산 tower": '{"mood": ["odd"], "scene_elements": ["바다"], "description": "d"}', "남산": '{"mood": [], "scene_elements": ["자막"], "description": " x "}', "": "none", "tower": '{"mood": ["calm"], "scene_elements": [], "description": "d"}', "강": '{"mood": ["calm"], "description": "d"}'}[place]

    out = tagging.tagged_catalog(seg, captions, annotate, {"mood": ["calm"]}, {"mood": ["plain"]}, ["자막"])
    got = [(x.tags_ok, x.mood, x.scene_elements, x.description) for x in out.orderBy("segment_id").collect()]
    assert got == [(False, ["plain"], ["남산"], "남산 tower" + T.FALLBACK_DESCRIPTION), (True, ["plain"], ["남산"], "x"), (False, ["plain"], ["촬영지"], T.FALLBACK_DESCRIPTION), (True, ["calm"], ["풍경"], "d"), (False, ["plain"], ["강"], "강" + T.FALLBACK_DESCRIPTION)]


def test_store_refuses_a_path_under_two_ids(spark, tmp_path):
    def tables(key):
        frame = spark.createDataFrame([(key, "s", "p/1")], "keyframe_id string, segment_id string, keyframe_path string")
        return {"video_segments": spark.createDataFrame([("s", "v")], "segment_id string, video_id string"), "segment_keyframes": frame}

    root = f"file://{tmp_path}/store"
    assert store.version(spark, root) == 0 and store.read(spark, root) == {}
    assert store.load(spark, root, tables("a")) == 1 and store.load(spark, root, tables("b")) == 2
    assert [x.keyframe_id for x in store.read(spark, root)["segment_keyframes"].collect()] == ["b"]  # the stale one went
    two = tables("a")
    two["segment_keyframes"] = two["segment_keyframes"].union(tables("b")["segment_keyframes"])
    with pytest.raises(ValueError, match="two ids"):
        store.load(spark, root, two)
    assert store.version(spark, root) == 2


def test_store_refuses_a_version_that_is_taken(spark, tmp_path):
    """Of two writers that start together the second fails, and the first one's tables stay."""
    t = lambda v: {"videos": spark.createDataFrame([("a", v)], "video_id string, title string")}
    root = str(tmp_path)
    assert store.publish(spark, root, t("x")) == 1
    start = store.version(spark, root)
    assert store.publish(spark, root, t("first"), start) == 2
    with pytest.raises(store.VersionTaken):
        store.publish(spark, root, t("second"), start)
    assert store.read(spark, root)["videos"].first().title == "first" and store.publish(spark, root, t("third")) == 3


@pytest.mark.parametrize("band", [512, 3, 1])
def test_stencils_by_bands(spark, band):
    """Bands with halos change nothing; one exchange on frame and band, none on lines and columns."""
    r = np.random.default_rng(band)
    shapes = {0: (7, 9), 1: (1, 5), 2: (6, 1), 3: (1, 1), 4: (13, 4)}
    data = {k: r.integers(0, 256, n) for k, n in shapes.items()}
    px = spark.createDataFrame([(k, x, y, int(g[y, x])) for k, g in data.items() for y in range(g.shape[0]) for x in range(g.shape[1])], "frame_id int, x int, y int, gray int")
    out = X.stencils(px, band)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 2
    got = {x.frame_id: (x.laplacian, x.tenengrad) for x in out.collect()}
    near = lambda a, y, x: a[y if 0 <= y < len(a) else 0 if len(a) == 1 else 1 if y < 0 else len(a) - 2, x if 0 <= x < a.shape[1] else 0 if a.shape[1] == 1 else 1 if x < 0 else a.shape[1] - 2]
    for k, g in data.items():
        g = g.astype(float)
        lap, energy = [], []
        for y in range(len(g)):
            for x in range(g.shape[1]):
                at = lambda dy, dx: near(g, y + dy, x + dx)  # noqa: B023, E731
                lap.append(at(0, -1) + at(0, 1) + at(-1, 0) + at(1, 0) - 4 * g[y, x])
                gx = sum(w * (at(d, 1) - at(d, -1)) for d, w in ((-1, 1), (0, 2), (1, 1)))
                gy = sum(w * (at(1, d) - at(-1, d)) for d, w in ((-1, 1), (0, 2), (1, 1)))
                energy.append(gx * gx + gy * gy)
        assert got[k] == pytest.approx((np.var(lap), np.mean(energy)), rel=1e-9, abs=1e-6)


def test_stream_resumes(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, "k long, at long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: incremental.run_stream(spark, f"{tmp_path}/in", "k long, at long, v string", "k", "at", ["at", "v"], f"{tmp_path}/out", f"{tmp_path}/cp")
    put([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")])
    run()
    put([(2, 5, "d"), (3, 1, "e")])
    run()
    run()
    assert sorted(map(tuple, incremental.latest(spark, f"{tmp_path}/out").collect())) == [(1, 2, "b"), (2, 5, "d"), (3, 1, "e")]


def test_records_fail_alone(spark):
    """Raising, retrying, results that do not fit, and clashing names: one status row a record, in their columns."""
    seen = {}

    def work(r):
        seen[r["k"]] = seen.get(r["k"], 0) + 1
        if r["k"] % 5 == 0 or (r["k"] % 5 == 1 and seen[r["k"]] < 3):
            raise KeyError(r["k"])
        return {"k": r["k"]} | {"twice": r["k"] * 2} if r["k"] % 5 < 4 else {"other": 1}

    df = spark.createDataFrame([(i, str(i), [1, 2], "old") for i in range(50)], "k long, name string, list array<int>, status string")
    got = {int(r.name): r for r in records.isolated(df, work, "k long, twice long", retries=2).collect()}
    assert {i: (r.status, r.attempts) for i, r in got.items()} == {i: ("failed", 3) if i % 5 in (0, 4) else ("completed", 3 if i % 5 == 1 else 1) for i in range(50)}
    assert got[7].twice == 14 and got[7].k == 7 and got[7].list == [1, 2] and got[5].k is None
    assert got[10].error == "KeyError: 10" and "unknown columns" in got[4].error and got[7].error is None
    assert records.isolated(df.limit(0), work, "twice long").count() == 0


def test_stream_goes_on_after_failures(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, "k long, at long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def upper(r):
        return {"big": r["v"].upper()}

    run = lambda: incremental.run_stream(spark, f"{tmp_path}/in", "k long, at long, v string", "k", "at", ["at", "v", "big"], f"{tmp_path}/out", f"{tmp_path}/cp", lambda rows: records.isolated(rows, upper, "big string"))
    put([(1, 1, "a"), (2, 1, None)])
    run()
    put([(2, 2, "b"), (1, 5, None), (3, 1, "c")])
    run()
    assert sorted((x.k, x.at, x.big) for x in incremental.latest(spark, f"{tmp_path}/out").collect()) == [(1, 1, "A"), (2, 2, "B"), (3, 1, "C")]
    assert sorted((x.k, x.at, x.attempts) for x in incremental.quarantined(spark, f"{tmp_path}/out").collect()) == [(1, 5, 2), (2, 1, 2)]


def test_encoder_loads_once_a_worker(spark, tmp_path):
    """Many tasks and batches, one load in each Python worker; batches keep to their cost, and vectors to their rows."""
    log = str(tmp_path / "loads")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")

        def model(items):
            assert len(items) <= 8 and max(map(len, items)) * len(items) <= 400
            return [[len(x), x.count("a")] for x in items]

        return model

    encoder = Encoder(f"lengths-{tmp_path}", load, 2, most=8, cost=400)
    rows = [(i, "a" * (i % 90 + 1) + "b" * (i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, x string").repartition(16)
    for _ in range(2):
        got = {r.i: r.v for r in G.encoded(df, "x", encoder, 2, "v").collect()}
        assert got == {i: [len(x), x.count("a")] for i, x in rows}
    pids = open(log).read().split()
    assert len(pids) == len(set(pids)) <= 16
    assert sorted(i for b in encoder.batches([x for _, x in rows]) for i in b) == list(range(600))
    for bad in (Encoder(f"bad-{tmp_path}", lambda: lambda items: [[1.0]] * len(items), 2), Encoder(f"few-{tmp_path}", lambda: lambda items: [], 2)):
        with pytest.raises(Exception, match="gave"):
            G.encoded(df, "x", bad, 2, "v").collect()
    with pytest.raises(ValueError, match="not 3"):
        G.encoded(df, "x", encoder, 3, "v")


_VALUES = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-9, 99), st.text(st.sampled_from('a"\\\\{}[], é\n'), max_size=6)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(st.sampled_from('k"}'), max_size=2), x, max_size=3)), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(_VALUES, max_size=6), st.sampled_from([None, 1]), st.data())
def test_elements_of_chunks(values, indent, data):
    """Any array, cut behind any of its closing braces: the parts put together are its elements."""
    text = json.dumps(values, ensure_ascii=data.draw(st.booleans()), indent=indent)
    ends = [i + 1 for i, c in enumerate(text) if c == "}"]
    cuts = sorted(data.draw(st.sets(st.sampled_from(ends), max_size=4))) if ends else []
    inside, depth, found = False, 0, []
    for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
        if a == b:
            continue
        for kind, part in arrays.cut_elements(text[a:b], inside, depth):
            if kind in ("whole", "tail"):
                found.append("")
            found[-1] += part
        change = arrays.summary(text[a:b], inside)
        inside, depth = change[0], depth + change[1]
    assert [json.loads(x) for x in found] == values


def test_large_array_file_splits(spark, tmp_path):
    """One file in many tasks: all elements once, in order, with strings full of brackets and elements across chunks."""
    items = [{"segment_id": f"S{i}", "description": '}{"][,\\' * (i % 50) + "é", "start_time": i / 2, "mood": ["a}", "b"] * (i % 3), "nested": {"x": [{"y": i}] * (i % 4)}} for i in range(4000)]
    (tmp_path / "a.json").write_text("\ufeff" + json.dumps(items, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([{"segment_id": "last"}], indent=2), encoding="utf-8")
    (tmp_path / "c.json").write_text(" [ ] ", encoding="utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = io.read_metadata(spark, str(tmp_path), io.METADATA)
        assert rows.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 8
        got = rows.orderBy("item_idx").collect()
        places = sorted(x.item_idx for x in io.read_items(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [(x.segment_id, x.description, x.start_time, x.mood) for x in got] == [(x["segment_id"], x["description"], x["start_time"], x["mood"]) for x in items] + [("last", None, None, None)]
    assert len({x.item_idx for x in got}) == len(got) and places == sorted([0, *range(4000)])


def test_metadata_file_must_be_an_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿[{"segment_id": "S", "start_time": 1.5, "mood": ["m"]}, {"segment_id": "T"}]', encoding="utf-8")
    rows = io.read_metadata(spark, f"{tmp_path}/a.json").orderBy("item_idx").collect()
    assert [(x.segment_id, x.start_time, x.mood) for x in rows] == [("S", 1.5, ["m"]), ("T", None, None)]
    (tmp_path / "b.json").write_text('{"segment_id": "S"}')
    with pytest.raises(Exception, match="not an array"):
        io.read_items(spark, f"{tmp_path}/b.json").collect()
    with pytest.raises(ValueError, match="not an array"):
        io.read_metadata(spark, f"{tmp_path}/b.json")


def test_annotator_failures_fall_back(spark):
    calls = {"n": 0}

    def annotate(x):
        calls["n"] += 1
        if x == "bad":
            raise RuntimeError
        return '{"mood": ["calm"]'

    df = spark.createDataFrame([("good",), ("bad",)], "x string")
    rows = tagging.annotated(df, ["x"], annotate).collect()
    assert {r.x: r.reply for r in rows} == {"good": '{"mood": ["calm"]', "bad": None}
    got = {r.x: (r.tags_ok, r.mood) for r in tagging.annotated(df, ["x"], annotate).select("x", *(c.alias(n) for n, c in tagging.tag_record(tagging.parsed_tags(F.col("reply"), ["mood"]), {"mood": ["calm"]}, {"mood": ["plain"]}).items())).collect()}
    assert got["bad"] == (False, ["plain"])
