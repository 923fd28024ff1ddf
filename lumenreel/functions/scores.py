"""Scene scores as column arithmetic: seasons, sharpness, exposure, totals and rejection reasons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenreel.functions.text import SEASONS

# What divides each metric before it is clamped to 0..1.
SEASON_SCALES = {
    "green": 0.30, "yellow": 0.16, "pink": 0.10, "warm": 0.20, "brown": 0.20, "blue": 0.28, "white": 0.42, "white_upper": 0.30,
    "white_lower": 0.42, "white_largest": 0.24, "white_edge": 0.20, "low_saturation": 0.70, "saturation": 0.55,
}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column, digits: int) -> Column:
    """``x`` to some digits, halves away from zero, where a half is told by the scaled number.

    0.5 * 29.09 + 0.5 * 29.11 is 14.549999999999999 after halving, and its tenfold 145.5: binary noise does not decide.
    """
    m = 10.0**digits
    return F.when(F.abs(x) < 1e300, F.round(x * m) / m).otherwise(x)


def season_scores(m: Mapping[str, Column]) -> dict[str, Column]:
    """Scores of the four seasons from a scene's median metrics: the keys of SEASON_SCALES, brightness and contrast."""
    v = {k: clamp(m[k] / s) for k, s in SEASON_SCALES.items()}
    bright, contrast = clamp((m["brightness"] - 55) / 125), clamp(m["contrast"] / 65)
    scattered = clamp(F.greatest(F.lit(0.0), m["white"] - m["white_largest"]) / 0.18)
    snow = clamp(0.58 * v["white_lower"] + 0.42 * v["white_largest"])
    vivid = F.greatest(v["pink"], v["yellow"])
    blossom = clamp(0.34 * v["white_upper"] + 0.28 * scattered + 0.18 * v["white_edge"] + 0.12 * v["green"] + 0.08 * vivid - 0.42 * snow)
    flower = F.greatest(vivid, blossom)
    spring = 0.23 * v["green"] + 0.22 * v["pink"] + 0.17 * v["yellow"] + 0.24 * blossom + 0.08 * bright + 0.06 * v["saturation"]
    summer = 0.55 * v["green"] + 0.18 * v["blue"] + 0.15 * v["saturation"] + 0.12 * bright - 0.10 * flower - 0.10 * F.greatest(v["warm"], v["brown"]) - 0.12 * snow
    autumn = 0.43 * v["warm"] + 0.25 * v["brown"] + 0.17 * v["yellow"] + 0.08 * contrast + 0.07 * bright - 0.13 * snow - 0.07 * blossom
    winter = 0.50 * snow + 0.18 * v["low_saturation"] + 0.10 * v["blue"] + 0.08 * bright + 0.06 * v["white"] - 0.22 * blossom - 0.12 * v["warm"] - 0.10 * v["brown"] - 0.10 * v["green"]
    return {s: rounded(clamp(x), 5) for s, x in zip(SEASONS, (spring, summer, autumn, winter), strict=True)}


def best_season(scores: Mapping[str, Column]) -> Column:
    """The first season with the largest score."""
    ranked = [F.struct((-scores[s]).alias("s"), F.lit(i).alias("i"), F.lit(s).alias("name")) for i, s in enumerate(SEASONS)]
    return F.array_min(F.array(*ranked))["name"]


def season_sets(expected: Column) -> tuple[Column, Column]:
    """(expected seasons that are known, the other known ones)."""
    known = F.array(*map(F.lit, SEASONS))
    return F.array_intersect(expected, known), F.array_except(known, expected)


def season_match(scores: Mapping[str, Column], expected: Column) -> tuple[Column, Column, Column]:
    """(expected season with the best score, its score, best score of the others); without expectation '' and 1.0."""
    inside, _ = season_sets(expected)
    of = lambda want: F.array_min(F.filter(F.array(*(F.struct((-scores[s]).alias("s"), F.lit(i).alias("i"), F.lit(s).alias("name")) for i, s in enumerate(SEASONS))), lambda x: F.array_contains(inside, x["name"]) == want))
    some = F.coalesce(F.size(inside) > 0, F.lit(False))
    return F.when(some, of(True)["name"]).otherwise(""), F.when(some, -of(True)["s"]).otherwise(1.0), F.when(some, F.coalesce(-of(False)["s"], F.lit(0.0))).otherwise(0.0)


def sharpness(laplacian: Column, tenengrad: Column) -> Column:
    log = lambda x, low, high: clamp((F.log1p(x) - F.log1p(F.lit(low))) / (F.log1p(F.lit(high)) - F.log1p(F.lit(low))))
    return 0.62 * log(laplacian, 35.0, 1200.0) + 0.38 * log(tenengrad, 180.0, 8000.0)


def scene_score(m: Mapping[str, Column]) -> Column:
    """Weighted total of a scene: median_sharpness, best_sharpness, season_score, brightness, dark, over, edge_density,
    contrast, saturation, duration, confidence."""
    length = clamp(1 - F.abs(m["duration"] - 7) / 7)
    exposure = clamp(1 - F.abs(m["brightness"] - 130) / 130 - 0.35 * m["dark"] - 0.35 * m["over"])
    information = clamp(0.55 * clamp(m["edge_density"] / 0.14) + 0.25 * clamp(m["contrast"] / 62) + 0.20 * clamp(m["saturation"] / 0.48))
    total = 0.34 * m["median_sharpness"] + 0.19 * m["best_sharpness"] + 0.20 * m["season_score"] + 0.10 * exposure + 0.09 * information + 0.05 * length + 0.03 * m["confidence"]
    return rounded(total, 6)


def rejection_reasons(m: Mapping[str, Column], rules: Mapping[str, float]) -> Column:
    """Texts of all failed tests, in a fixed order, each with the number that failed."""
    tests = [
        (m["median_sharpness"] < rules["minimum_median_sharpness"], "low median sharpness ", 3, m["median_sharpness"]),
        (m["best_sharpness"] < rules["minimum_best_frame_sharpness"], "low best sharpness ", 3, m["best_sharpness"]),
        (m["blurry_ratio"] > rules["maximum_blurry_frame_ratio"], "too many blurry frames ", 2, m["blurry_ratio"]),
        (m["brightness"] < rules["minimum_brightness"], "too dark ", 1, m["brightness"]),
        (m["brightness"] > rules["maximum_brightness"], "too bright ", 1, m["brightness"]),
        (m["dark"] > rules["maximum_dark_pixel_ratio"], "too many dark pixels ", 2, m["dark"]),
        (m["over"] > rules["maximum_overexposed_pixel_ratio"], "too many overexposed pixels ", 2, m["over"]),
        (m["season_score"] < rules["minimum_expected_season_score"], "low season score ", 3, m["season_score"]),
        (m["other_score"] - m["season_score"] > rules["maximum_other_season_advantage"], "another season fits better ", 3, m["other_score"] - m["season_score"]),
    ]
    return F.array_compact(F.array(*(F.when(t, F.format_string(f"{text}(%.{n}f)", rounded(x.cast("double"), n))) for t, text, n, x in tests)))
