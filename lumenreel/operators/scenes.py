"""Scenes of a frame series: boundaries, intervals, evaluation, and diverse selection.

A series has key columns (video, range) and a time.  All window steps of boundary detection share the partition keys, so
that one exchange serves them.  What is greedy is folded over no more than has to be looked at together: boundaries in runs
of peaks that are closer than the gap, selections over a sorted stream that keeps the chosen ones of one video.  Orders are
by time and, where frames can share one, by the columns given as ``tie``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.functions import scores as S
from lumenreel.functions.vectors import bhattacharyya
from lumenreel.sources.folders import kept

#: Rows of one group from which its median is taken by counting, and how many such groups may be broadcast.
HOT_GROUP = 1_000_000
BROADCAST_GROUPS = 100_000

# ---- boundaries


def frame_differences(frames: DataFrame, keys: Sequence[str], t: str, histogram: str, gray: str | None = None, edges: str | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """``frames`` with ``diff`` to the frame before: 0.58 histogram + 0.24 gray + 0.18 edge difference; first frames go."""
    w = W.partitionBy(*keys).orderBy(t, *tie)
    mean_abs = lambda c: F.aggregate(F.zip_with(F.col(c), F.lag(c).over(w), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(c) / 255
    parts = 0.58 * bhattacharyya(F.lag(histogram).over(w), F.col(histogram))
    for weight, c in ((0.24, gray), (0.18, edges)):
        if c is not None:
            parts = parts + weight * mean_abs(c)
    return frames.withColumn("diff", parts).filter(F.col("diff").isNotNull())


def hot_groups(rows: DataFrame, keys: Sequence[str], hot: int | None = None) -> DataFrame | None:
    """The keys of groups with more than ``hot`` rows; None if there is none."""
    large = rows.groupBy(*keys).count().filter(F.col("count") > (HOT_GROUP if hot is None else hot)).select(*keys)
    return None if large.isEmpty() else kept(large)


def medians(rows: DataFrame, keys: Sequence[str], value: str, large: DataFrame | None = None) -> DataFrame:
    """(keys, n, med): number of rows and exact median of ``value`` in each group.

    The values of the groups in ``large`` (see hot_groups) are never gathered: a mergeable sketch gives a narrow bracket that
    holds the middle, one pass counts what lies below it, and what lies inside is counted value by value.
    """
    keys = list(keys)
    plain = lambda df: df.groupBy(*keys).agg(F.count("*").alias("n"), F.median(value).alias("med"))
    if large is None:
        return plain(rows)
    match = [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    few = F.broadcast(large) if large.count() <= BROADCAST_GROUPS else large
    mine, others = (rows.alias("r").join(few.alias("l"), match, how) for how in ("left_semi", "left_anti"))
    mine = mine.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    # The sketch is off by at most n / 10000 ranks, so the middle is inside.
    ends = F.percentile_approx("v", F.array(F.lit(0.4995), F.lit(0.5005)), F.lit(10_000))
    brackets = mine.groupBy(*keys).agg(ends.alias("e")).select(*keys, F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))
    held = mine.alias("r").join(F.broadcast(brackets.alias("l")) if large.count() <= BROADCAST_GROUPS else brackets.alias("l"), match).select(*(F.col(f"r.{k}") for k in keys), "v", "low", "high")
    below = held.groupBy(*keys).agg(F.count_if(F.col("v") < F.col("low")).alias("below"), F.count("*").alias("m"))
    inside = held.filter(F.col("v").between(F.col("low"), F.col("high"))).groupBy(*keys, "v").agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("c").over(w)).alias("r").join(below.alias("l"), match).select(*(F.col(f"r.{k}") for k in keys), "v", "c", (F.col("below") + F.col("upto")).alias("upto"), "m")
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))  # noqa: E731  the first value that reaches a rank
    middle = inside.groupBy(*keys).agg(((at(F.floor((F.col("m") - 1) / 2)) + at(F.floor(F.col("m") / 2))) / 2).alias("med"))
    n = rows.alias("r").join(few.alias("l"), match, "left_semi").groupBy(*keys).agg(F.count("*").alias("n"))
    large = n.alias("r").join(middle.alias("l"), match, "left").select(*(F.col(f"r.{k}") for k in keys), "n", "med")
    return plain(others).unionByName(large)


def robust_threshold(diffs: DataFrame, keys: Sequence[str], base: float, multiplier: float, value: str = "diff", hot: int | None = None) -> DataFrame:
    """(keys, n, threshold): median plus a multiple of the median absolute deviation, within [base, 0.78]."""
    large = hot_groups(diffs, keys, hot)
    med = medians(diffs, keys, value, large)
    away = diffs.join(med, list(keys)).select(*keys, "med", F.abs(F.col(value) - F.col("med")).alias("_away"))
    mad = med.join(medians(away, keys, "_away", large).select(*keys, F.col("med").alias("mad")), list(keys))
    adaptive = F.greatest(F.lit(base), F.least(F.lit(0.78), F.col("med") + multiplier * F.greatest("mad", F.lit(0.008))))
    return mad.select(*keys, "n", F.when(F.col("n") < 3, F.lit(base)).otherwise(adaptive).alias("threshold"))


def peaks(diffs: DataFrame, thresholds: DataFrame, keys: Sequence[str], t: str, value: str = "diff", tie: Sequence[str] = ()) -> DataFrame:
    """Local maxima at or above the threshold, with both neighbours present: keys, t, value, confidence."""
    w = W.partitionBy(*keys).orderBy(t, *tie)
    rows = diffs.select(*keys, t, value, F.lag(value).over(w).alias("_a"), F.lead(value).over(w).alias("_b")).join(thresholds, list(keys))
    top = rows.filter((F.col("n") >= 3) & (F.col(value) >= F.col("threshold")) & (F.col(value) >= F.col("_a")) & (F.col(value) >= F.col("_b")))
    over = (F.col(value) - F.col("threshold")) / F.greatest(F.lit(0.10), 1 - F.col("threshold"))
    return top.select(*keys, t, S.rounded(F.col(value), 4).alias("value"), S.rounded(S.clamp(over + 0.55), 3).alias("confidence"))


def spaced(items: Column, gap: float) -> Column:
    """Greedy choice from ``items`` (structs of confidence and t): best first, the earlier of equals, each at least ``gap`` from all chosen."""
    ranked = F.array_sort(F.transform(items, lambda x: F.struct((-x["confidence"]).alias("c"), x["t"].alias("t"))))
    add = lambda acc, x: F.when(F.exists(acc, lambda b: F.abs(b["t"] - x["t"]) < gap), acc).otherwise(F.concat(acc, F.array(x)))
    chosen = F.aggregate(ranked, F.array().cast("array<struct<c:double,t:double>>"), add)
    return F.transform(chosen, lambda x: F.struct((-x["c"]).alias("confidence"), x["t"].alias("t")))


def spaced_peaks(found: DataFrame, ranges: DataFrame, keys: Sequence[str], t: str, gap: float) -> DataFrame:
    """(keys, t, confidence): the greedy choice of each range's peaks, all at least ``gap`` from the range's start.

    Peaks that lie ``gap`` apart or more do not see each other, so the choice is made run by run: a run ends where the next
    peak is that far, and only a run's peaks are gathered.
    """
    rows = found.select(*keys, F.col(t).cast("double").alias("t"), F.col("confidence").cast("double").alias("confidence")).join(ranges.select(*keys, F.col("start").alias("_start")), list(keys))
    rows = rows.filter(F.abs(F.col("t") - F.col("_start")) >= gap)
    w = W.partitionBy(*keys).orderBy("t", "confidence")
    first = F.coalesce(F.col("t") - F.lag("t").over(w) >= gap, F.lit(True))
    rows = rows.select(*keys, "t", "confidence", first.alias("_first")).withColumn("_run", F.sum(F.col("_first").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "_run").agg(F.collect_list(F.struct("confidence", "t")).alias("peaks"))
    return runs.select(*keys, F.explode(spaced(F.col("peaks"), gap)).alias("x")).select(*keys, "x.t", "x.confidence")


def intervals(chosen: DataFrame, ranges: DataFrame, keys: Sequence[str], least_tail: float = 0.8) -> DataFrame:
    """(keys, scene_idx, n_scenes, start, end, confidence): ranges cut at their chosen peaks ``(keys, t, confidence)``.

    A last cut less than ``least_tail`` before the end is left out.  ``confidence`` is the mean of both ends' peak
    confidence; 0.70 at the outer ends, 0.75 for a cut without one.
    """
    double = lambda c: F.col(c).cast("double")
    starts = ranges.select(*keys, double("start").alias("t"), F.lit(None).cast("double").alias("confidence"), double("end").alias("_end"), F.lit(True).alias("_outer"))
    cuts = chosen.join(ranges.select(*keys, double("end").alias("_end")), list(keys)).select(*keys, "t", "confidence", "_end", F.lit(False).alias("_outer"))
    w = W.partitionBy(*keys).orderBy("t", F.desc("_outer"))
    rows = starts.unionByName(cuts).withColumn("_next", F.lead("t").over(w))
    rows = rows.filter(F.col("_outer") | F.col("_next").isNotNull() | (F.col("_end") - F.col("t") >= least_tail))
    mine = F.when(F.col("_outer"), 0.70).otherwise(F.coalesce("confidence", F.lit(0.75)))
    after = F.when(F.lead("t").over(w).isNull(), 0.70).otherwise(F.coalesce(F.lead("confidence").over(w), F.lit(0.75)))
    rows = rows.select(*keys, (F.row_number().over(w) - 1).alias("scene_idx"), F.count("*").over(W.partitionBy(*keys)).cast("int").alias("n_scenes"), F.col("t").alias("start"), F.coalesce(F.lead("t").over(w), F.col("_end")).alias("end"), ((mine + after) / 2).alias("confidence"))
    return rows


def padded(scenes: DataFrame, padding: float, least: float) -> DataFrame:
    """Scenes without their transitions: ``padding`` at inner ends, at most 0.15 at outer ones; short ones go."""
    outer = min(padding, 0.15)
    s = F.col("start") + F.when(F.col("scene_idx") == 0, outer).otherwise(padding)
    e = F.col("end") - F.when(F.col("scene_idx") == F.col("n_scenes") - 1, outer).otherwise(padding)
    return scenes.withColumn("start", s).withColumn("end", e).filter(F.col("end") - F.col("start") >= least)


def sample_times(start: Column, end: Column, n: int) -> Column:
    """``n`` times inside a scene, between 8 and 92 percent; the middle for n <= 1; none for an empty scene."""
    d = end - start
    some = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + d * (0.08 + 0.84 * i / (n - 1))) if n > 1 else F.array((start + end) / 2)
    return F.when(d > 0, some).otherwise(F.array().cast("array<double>"))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], tie: Sequence[str] = (), width: float = 3600.0) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of the same key at or before its time; null if there is none.

    Of right rows with one time the last by ``tie`` counts.  A long video spreads over many tasks: time is cut into buckets of
    ``width``, each bucket's last row is carried into the next one that has rows, and rows are put in order inside buckets
    only.  A task holds nothing but the value that it carries on.
    """
    carry = F.struct(*values)
    kind = right.select(carry.alias("x")).schema["x"].dataType
    bucket = F.floor(F.col(t) / width)
    extra = [F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)]
    r = right.filter(F.col(t).isNotNull()).select(*keys, F.col(t).alias("_at"), bucket.alias("_b"), carry.alias("_r"), F.lit(1).alias("_o"), *extra)
    none = F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_l")
    rows = left.select(*keys, F.col(t).alias("_at"), bucket.alias("_b"), F.lit(None).cast(kind).alias("_r"), F.lit(2).alias("_o"), *(F.lit(None).cast(r.schema[f"_t{i}"].dataType).alias(f"_t{i}") for i in range(len(tie))), F.struct(*left.columns).alias("_l"))
    rows = rows.unionByName(r.withColumn("_l", none))
    order = ["_at", "_o", *(f"_t{i}" for i in range(len(tie)))]
    last = r.groupBy(*keys, "_b").agg(F.max_by("_r", F.struct("_at", *order[2:])).alias("_r"))
    asked = left.select(*keys, bucket.alias("_b")).distinct().select("*", F.lit(None).cast(kind).alias("_r"), F.lit(0).alias("_o"))
    before = W.partitionBy(*keys).orderBy("_b", "_o").rowsBetween(W.unboundedPreceding, -1)  # what is asked for in a bucket comes before its own last row
    carried = asked.unionByName(last.withColumn("_o", F.lit(1))).withColumn("_r", F.last("_r", ignorenulls=True).over(before)).filter((F.col("_o") == 0) & F.col("_r").isNotNull())
    fill = [F.lit(None).cast(r.schema[c].dataType).alias(c) for c in order[2:]]
    rows = rows.unionByName(carried.select(*keys, F.lit(None).cast(r.schema["_at"].dataType).alias("_at"), "_b", "_r", F.lit(0).alias("_o"), *fill, none))
    w = W.partitionBy(*keys, "_b").orderBy(*(F.asc_nulls_first(c) for c in order)).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull())
    found = F.when(F.col("_l")[t].isNotNull(), F.col("_r"))
    return rows.select("_l.*", *(found[v].alias(v) for v in values))


def overlapping(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of intervals of one key that touch: ``left(key, id, start, end)``, ``right(key, start, end, ...)``.

    Time is cut into cells of ``width`` times 1, 2, 4 and so on, so that a long video spreads over many tasks.  An interval
    lies in at most two cells of the first size that is not below its length, and in at most two of each larger size that
    any interval has; two intervals meet at the larger of their sizes, in the first cell that both have.  The number of
    copies grows with the logarithm of the longest interval.
    """
    level = lambda s, e: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(e - s, F.lit(width)) / width))).cast("int")
    sides = [side.withColumn("_own", level(F.col("start"), F.col("end"))) for side in (left, right)]
    sizes = sorted({r._own for side in sides for r in side.select("_own").distinct().collect() if r._own is not None})  # at most a few dozen
    if not sizes:
        sizes = [0]
    all_ = F.array(*(F.lit(n) for n in sizes))

    def cells(side: DataFrame) -> DataFrame:
        rows = side.withColumn("_size", F.explode(F.filter(all_, lambda n: n >= F.col("_own"))))
        w = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_size"))
        return rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / w), F.floor(F.greatest("start", "end") / w))))

    x, y = (cells(side).alias(name) for side, name in zip(sides, ("x", "y"), strict=True))
    touch = (F.col("y.end") >= F.col("x.start")) & (F.col("y.start") <= F.col("x.end"))
    size = (F.col("x._size") == F.col("y._size")) & (F.col("x._size") == F.greatest("x._own", "y._own"))
    first = F.col("x._cell") == F.floor(F.greatest(F.col("x.start"), F.col("y.start")) / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("x._size"))))
    return x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x._cell") == F.col("y._cell")) & size & touch & first)


# ---- evaluation


def scene_medians(frames: DataFrame, keys: Sequence[str], metrics: Sequence[str], blur_threshold: float) -> DataFrame:
    """Per scene: exact medians of the metrics, number of frames, share of blurry ones, and the sharpest (first) frame."""
    best = F.min_by(F.struct("t", "sharpness", "frame_idx"), F.struct((-F.col("sharpness")).alias("s"), F.col("frame_idx")))
    return frames.groupBy(*keys).agg(*(F.median(m).alias(m) for m in metrics), F.count("*").alias("n_frames"), F.avg(F.when(F.col("sharpness") < blur_threshold, 1.0).otherwise(0.0)).alias("blurry_ratio"), best.alias("best_frame"))


def evaluated(scenes: DataFrame, rules: Mapping[str, float]) -> DataFrame:
    """Scenes with season scores, detected and expected season, rejection reasons, acceptance and total score.

    ``scenes`` has the medians, ``expected`` (list of seasons), ``duration`` and ``confidence``.  A scene of fewer than
    four frames gets zero scores and one fixed reason.
    """
    few = F.col("n_frames") < 4
    scores = S.season_scores({k: F.col(k) for k in (*S.SEASON_SCALES, "brightness", "contrast")})
    name, score, other = S.season_match(scores, F.col("expected"))
    rows = scenes.withColumn("season_scores", F.struct(*(v.alias(k) for k, v in scores.items())))
    rows = rows.withColumns({"detected_season": S.best_season(scores), "expected_season": name, "season_score": score, "other_score": other})
    m = {c: F.col(c) for c in ("brightness", "dark", "over", "edge_density", "contrast", "saturation", "duration", "confidence", "season_score", "other_score", "blurry_ratio")}
    m |= {"median_sharpness": F.col("sharpness"), "best_sharpness": F.col("best_frame.sharpness")}
    reasons = F.when(few, F.array(F.lit("too few readable frames"))).otherwise(S.rejection_reasons(m, rules))
    rows = rows.withColumn("rejection_reasons", reasons).withColumn("total_score", F.when(few, 0.0).otherwise(S.scene_score(m)))
    return rows.withColumn("accepted", F.size("rejection_reasons") == 0)


def verified_override(rows: DataFrame, verified: str = "verified_season") -> DataFrame:
    """Detected, expected and score replaced by a verified season's; the automatic values stay in ``auto_*`` columns."""
    ok = F.coalesce(F.col(verified).isin(*S.SEASONS), F.lit(False))
    of = F.coalesce(*(F.when(F.col(verified) == s, F.col(f"season_scores.{s}")) for s in S.SEASONS))
    rows = rows.withColumns({f"auto_{c}": F.col(c) for c in ("detected_season", "expected_season", "season_score")})
    return rows.withColumns({"season_verified": ok, "detected_season": F.when(ok, F.col(verified)).otherwise(F.col("detected_season")), "expected_season": F.when(ok, F.col(verified)).otherwise(F.col("expected_season")), "season_score": F.when(ok, of).otherwise(F.col("season_score"))})


def centred_window(scenes: DataFrame, frames: DataFrame, keys: Sequence[str], most: float) -> DataFrame:
    """Scenes longer than ``most`` cut to that length around their best frame; the middle if no frame is in reach.

    ``frames(keys, t, sharpness, brightness)``: frames inside the scene; those in the search span are scored.
    """
    score = 0.75 * F.col("sharpness") + 0.25 * S.clamp(1 - F.abs(F.col("brightness") - 130) / 130)
    near = frames.join(scenes.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e")), list(keys))
    near = near.filter((F.col("t") >= F.col("_s") + most / 2) & (F.col("t") <= F.col("_e") - most / 2))
    best = near.groupBy(*keys).agg(F.max_by("t", F.struct(score.alias("s"), (-F.col("t")).alias("t"))).alias("_c"))
    rows = scenes.join(best, list(keys), "left")
    c = F.coalesce("_c", (F.col("start") + F.col("end")) / 2)
    w0 = F.greatest("start", c - most / 2)
    w1 = F.least(F.col("end"), w0 + most)
    long = F.col("end") - F.col("start") > most
    return rows.withColumns({"start": F.when(long, F.greatest(F.col("start"), w1 - most)).otherwise(F.col("start")), "end": F.when(long, w1).otherwise(F.col("end"))}).drop("_c")


# ---- selection


def quota(source_type: Column, shorts: int, other: int, override: Column | None = None) -> Column:
    most = F.when(source_type == "쇼츠", shorts).otherwise(other)
    return most if override is None else F.coalesce(override, most)


def diverse_top(candidates: DataFrame, group: str, key: str | Sequence[str], score: str, histogram: str, most: str, limit: float) -> DataFrame:
    """Greedy diverse choice in each group: by falling score, up to ``most``, none too similar to one already chosen.

    Returns (group, key columns, chosen, reason): ``quota`` is tested before ``similar``.  Each task reads its groups in order
    and holds the histograms chosen so far of one of them; null, empty and constant histograms resemble none.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = candidates.select(group, *keys, F.col(histogram).cast("array<double>").alias("_h"), F.col(most).cast("long").alias("_most"), score)
    rows = rows.repartition(F.col(group)).sortWithinPartitions(group, F.desc_nulls_last(score), *keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chosen, new = None, [], True
        for b in batches:
            groups, limits = b.column(0).to_pylist(), b.column(1 + len(keys) + 1).to_pylist()
            out, why = [], []
            for g, h, n in zip(groups, (_centred(x) for x in b.column(1 + len(keys)).to_pylist()), limits, strict=True):
                if new or g != now:
                    now, chosen, new = g, [], False
                alike = lambda y: _correlation(y, h) >= limit  # noqa: B023, E731
                reason = "quota" if n is not None and len(chosen) >= n else "similar" if any(map(alike, chosen)) else None
                if reason is None:
                    chosen.append(h)
                out.append(reason is None)
                why.append(reason)
            yield pa.RecordBatch.from_arrays([*b.columns[: 1 + len(keys)], pa.array(out, pa.bool_()), pa.array(why, pa.string())], [group, *keys, "chosen", "reason"])

    kinds = dict(candidates.dtypes)
    return rows.mapInArrow(fold, ", ".join(f"`{c}` {kinds[c]}" for c in (group, *keys)) + ", chosen boolean, reason string")


def _centred(h: Sequence[float] | None) -> tuple[np.ndarray, float]:
    """A histogram less its mean, and the length of that; 0 where it has none."""
    x = np.asarray([np.nan if v is None else v for v in h or []], np.float64)
    x = x - x.mean() if len(x) else x
    n = float(np.sqrt(x @ x)) if len(x) else 0.0
    return x, n if np.isfinite(n) else 0.0


def _correlation(x: tuple[np.ndarray, float], y: tuple[np.ndarray, float]) -> float:
    """Pearson correlation of two centred histograms, 0 where there is none.

    One division at the end: unit vectors would be rounded one by one, and a correlation of just the limit could miss it.
    """
    (a, m), (b, n) = x, y
    return float(a @ b) / (m * n) if len(a) == len(b) and m * n > 0 else 0.0


def numbered(rows: DataFrame, video: str = "video_id", start: str = "start", chosen: str = "chosen", key: str | Sequence[str] = "scene_idx") -> DataFrame:
    """``scene_id``: ``{video}_SCENE_01`` ... of chosen rows in start order, ``{video}_REJECTED_001`` ... of the others."""
    n = F.row_number().over(W.partitionBy(video, chosen).orderBy(start, *([key] if isinstance(key, str) else key)))
    pad = lambda width: F.when(F.length(n.cast("string")) < width, F.lpad(n.cast("string"), width, "0")).otherwise(n.cast("string"))
    return rows.withColumn("scene_id", F.when(F.col(chosen), F.concat(F.col(video).cast("string"), F.lit("_SCENE_"), pad(2))).otherwise(F.concat(F.col(video).cast("string"), F.lit("_REJECTED_"), pad(3))))


def video_summary(rows: DataFrame, video: str = "video_id") -> DataFrame:
    return rows.groupBy(video).agg(F.count("*").alias("candidates"), F.count_if("chosen").alias("accepted"), F.count_if(~F.col("chosen")).alias("rejected"))


def rejected_scenes(rows: DataFrame, video: str = "video_id") -> DataFrame:
    """Videos that have rejected scenes, each with an ordered list of them."""
    return rows.filter("not chosen").groupBy(video).agg(F.array_sort(F.collect_list(F.struct("scene_id", "reason"))).alias("rejected"))


def ranges_of(candidates: Column, duration: Column) -> Column:
    """Candidate ranges clipped to [0, duration] without empty ones; the whole video if none is left."""
    kind = "array<struct<start_time:double,end_time:double>>"
    clip = F.transform(F.coalesce(candidates.cast(kind), F.array().cast(kind)), lambda r: F.struct(F.greatest(F.lit(0.0), r["start_time"]).alias("start_time"), F.least(duration, r["end_time"]).alias("end_time")))
    left = F.filter(clip, lambda r: r["end_time"] > r["start_time"])
    return F.when(F.size(left) > 0, left).otherwise(F.array(F.struct(F.lit(0.0).alias("start_time"), duration.cast("double").alias("end_time"))))


def video_ranges(videos: DataFrame, video: str = "video_id", candidates: str = "candidate_ranges", duration: str = "duration") -> DataFrame:
    """(video, range_idx, start, end): the usable ranges of each video, numbered in their order."""
    rows = videos.select(video, F.posexplode(ranges_of(F.col(candidates), F.col(duration))).alias("range_idx", "_r"))
    return rows.select(video, "range_idx", F.col("_r.start_time").alias("start"), F.col("_r.end_time").alias("end"))


def in_ranges(frames: DataFrame, ranges: DataFrame, video: str, t: str, width: float = 600.0) -> DataFrame:
    """``frames`` with ``range_idx``: each frame once for every range of its video that holds it, ends included.

    All later steps of a range start from these rows, so they are kept in the shared folder.
    """
    left = ranges.select(video, "range_idx", "start", "end")
    right = frames.select(video, F.col(t).cast("double").alias("start"), F.col(t).cast("double").alias("end"), F.struct("*").alias("_frame"))
    return kept(overlapping(left, right, video, width).select(F.col("y._frame").alias("_frame"), F.col("x.range_idx").alias("range_idx")).select("_frame.*", "range_idx"))


REPORT = ("video_id", "youtube_id", "drama_title", "candidate_start", "candidate_end", "accepted", "total_score", "sharpness_score", "expected_season", "season_score", "detected_season", "auto_detected_season", "verified_season", "season_verified", "season_match_required", "season_review_note", "rejection_reasons")


def quality_report(rows: DataFrame) -> DataFrame:
    """The 17 report columns; reasons joined by `` / ``, columns that ``rows`` lacks as nulls."""
    have = set(rows.columns)
    special = {"accepted": F.col("chosen"), "rejection_reasons": F.array_join("rejection_reasons", " / "), "candidate_start": F.col("start"), "candidate_end": F.col("end"), "sharpness_score": F.col("sharpness")}
    return rows.select(*((special[c] if c in special else F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in REPORT))


# ---- pipelines


def detect_scenes(diffs: DataFrame, ranges: DataFrame, keys: Sequence[str], t: str, rules: Mapping[str, float]) -> tuple[DataFrame, DataFrame]:
    """(scenes, thresholds) of ranges from a difference series; ranges with fewer than three differences are one scene."""
    thresholds = robust_threshold(diffs, keys, rules["base_cut_threshold"], rules["adaptive_mad_multiplier"])
    found = peaks(diffs, thresholds, keys, t)
    return intervals(spaced_peaks(found, ranges, keys, t, rules["minimum_cut_gap_seconds"]), ranges, keys), thresholds


def scene_candidates(diffs: DataFrame, frames: DataFrame, ranges: DataFrame, keys: Sequence[str], t: str, rules: Mapping[str, float], metrics: Sequence[str], expected: DataFrame) -> DataFrame:
    """Evaluated scenes of all ranges: detection, padding, window choice, frame sampling and evaluation.

    ``frames(keys, t, frame_idx, sharpness, metrics...)``; ``expected(keys[0], expected)``.  ``keys`` are a video and, where
    it has several ranges, the range: a scene is named by all of them and its ``scene_idx``.
    """
    scenes, _ = detect_scenes(diffs, ranges, keys, t, rules)
    scenes = kept(padded(scenes, rules["transition_padding_seconds"], rules["minimum_scene_seconds"]))
    full = [*keys, "scene_idx"]
    inside = overlapping_frames(scenes, frames, keys, t)
    scenes = centred_window(scenes, inside, full, rules["maximum_scene_seconds"])
    wanted = scenes.select(*full, F.explode(sample_times(F.col("start"), F.col("end"), int(rules["sample_frames_per_scene"]))).alias(t))
    sampled = as_of(wanted, frames, keys, t, ["frame_idx", "sharpness", *metrics], tie=["frame_idx"]).filter("frame_idx is not null")
    stats = scene_medians(sampled.withColumnRenamed(t, "t") if t != "t" else sampled, full, ["sharpness", *metrics], rules["minimum_best_frame_sharpness"])
    rows = scenes.join(stats, full).withColumn("duration", F.col("end") - F.col("start")).join(expected, keys[0], "left")
    return evaluated(rows, rules)


def processed_videos(diffs: DataFrame, frames: DataFrame, ranges: DataFrame, keys: Sequence[str], t: str, rules: Mapping[str, float], metrics: Sequence[str], expected: DataFrame, most: Column, histogram: Column, limit: float) -> DataFrame:
    """All scenes of all videos, from difference series to numbered results; ``chosen`` ones are a video's selection.

    Candidates that pass evaluation compete for a video's ``most`` places, none too similar to a better one; those that
    fail it, or lose, are numbered as rejected, with the selection's ``reason`` behind their own.  quality_report,
    video_summary and rejected_scenes take the result.
    """
    video, scene = keys[0], [*keys[1:], "scene_idx"]
    rows = scene_candidates(diffs, frames, ranges, keys, t, rules, metrics, expected)
    rows = kept(rows.withColumns({"most": most, "histogram": histogram}))
    top = diverse_top(rows.filter("accepted"), video, scene, "total_score", "histogram", "most", limit)
    rows = rows.join(top, [video, *scene], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    rows = rows.withColumn("rejection_reasons", F.array_compact(F.concat("rejection_reasons", F.array("reason"))))
    return numbered(rows.drop("most", "histogram"), video, key=scene)


def overlapping_frames(scenes: DataFrame, frames: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Frames with the scene that holds them, by an as-of join on the scenes' starts."""
    starts = scenes.select(*keys, F.col("start").alias(t), "scene_idx", F.col("end").alias("_end"))
    rows = as_of(frames, starts, keys, t, ["scene_idx", "_end"], tie=["scene_idx"])
    rows = rows.filter(F.col("scene_idx").isNotNull() & (F.col(t) <= F.col("_end"))).drop("_end")
    return rows.withColumnRenamed(t, "t") if t != "t" else rows
