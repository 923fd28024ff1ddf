"""Frame metrics from pixel rows: colour masks, exposure, histograms and sharpness stencils.

Pixels are rows ``(frame_id, x, y, h, s, v, gray)`` with hue 0 to 179 and other channels 0 to 255.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenreel.functions.scores import sharpness


def masks() -> dict[str, Column]:
    """Predicates of the eight colour masks."""
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    return {
        "green": h.between(30, 90) & (s >= 55) & (v >= 45),
        "yellow": h.between(18, 35) & (s >= 60) & (v >= 80),
        "pink": (h.between(145, 179) | h.between(0, 8)) & s.between(25, 175) & (v >= 125),
        "warm": (h.between(0, 20) | (h >= 165)) & (s >= 55) & (v >= 45),
        "brown": h.between(5, 28) & s.between(40, 210) & v.between(35, 185),
        "blue": h.between(90, 132) & (s >= 48) & (v >= 55),
        "white": (s <= 45) & (v >= 175),
        "low_saturation": s <= 48,
    }


def _share(c: Column) -> Column:
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def mask_ratios(pixels: DataFrame) -> DataFrame:
    """Share of each mask per frame, and of white in the upper 72 and the lower 60 percent of rows.

    Pixels are counted line by line before anything is shuffled; the height of a frame is looked up among its lines only.
    """
    m = masks()
    lines = pixels.groupBy("frame_id", "y").agg(F.count("*").alias("_n"), *(F.count_if(c).alias(k) for k, c in m.items()))
    lines = lines.withColumn("_height", F.max("y").over(W.partitionBy("frame_id")) + 1)
    upper = F.col("y") < F.greatest(F.lit(1), F.floor(0.72 * F.col("_height")))
    lower = F.col("y") >= F.floor(0.40 * F.col("_height"))
    share = lambda c, where=None: F.try_divide(F.sum(F.when(where, F.col(c)) if where is not None else c), F.sum(F.when(where, F.col("_n")) if where is not None else "_n"))
    return lines.groupBy("frame_id").agg(*(share(k).alias(k) for k in m), share("white", upper).alias("white_upper"), share("white", lower).alias("white_lower"))


def exposure(pixels: DataFrame) -> DataFrame:
    """Brightness, contrast, saturation (0..1), dark and overexposed shares per frame."""
    return pixels.groupBy("frame_id").agg(F.avg("gray").alias("brightness"), F.stddev_pop("gray").alias("contrast"), (F.avg("s") / 255).alias("saturation"), _share(F.col("gray") < 25).alias("dark"), _share(F.col("gray") > 245).alias("over"))


def colour_histogram(pixels: DataFrame, hues: int = 24, saturations: int = 16) -> DataFrame:
    """(frame_id, histogram): dense L2-normalised counts over hue by saturation."""
    n = hues * saturations
    at = (F.least(F.floor(F.col("h") * hues / 180), F.lit(hues - 1)) * saturations + F.least(F.floor(F.col("s") * saturations / 256), F.lit(saturations - 1))).cast("int")
    counts = pixels.groupBy("frame_id", at.alias("bin")).agg(F.count("*").cast("double").alias("n"))
    rows = counts.groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return rows.select("frame_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).alias("histogram"))


#: Lines of a frame that are one task's work; a taller frame is cut into bands of so many, with a line of halo on both sides.
BAND = 512


def _shifted(a: np.ndarray, axis: int, step: int) -> np.ndarray:
    """Neighbours along an axis; NaN beyond the frame."""
    out = np.full_like(a, np.nan)
    to, of = [slice(None)] * 2, [slice(None)] * 2
    to[axis], of[axis] = (slice(1, None), slice(None, -1)) if step < 0 else (slice(None, -1), slice(1, None))
    out[tuple(to)] = a[tuple(of)]
    return out


def _near(a: np.ndarray, axis: int, step: int) -> np.ndarray:
    """Neighbours along an axis; at an edge the one on the other side, alone the pixel itself."""
    one, other = _shifted(a, axis, step), _shifted(a, axis, -step)
    one = np.where(np.isnan(one), other, one)
    return np.where(np.isnan(one), a, one)


def stencil_sums(gray: np.ndarray, own: np.ndarray) -> tuple[int, float, float, float]:
    """(n, sum of the Laplacian, sum of its squares, sum of the Sobel energy) over the ``own`` lines of a matrix with NaN where there is no pixel."""
    left, right = _near(gray, 1, -1), _near(gray, 1, 1)
    dx, sx = right - left + 0 * gray, left + 2 * gray + right  # NaN where there is no pixel
    lap = (left + right + _near(gray, 0, -1) + _near(gray, 0, 1) - 4 * gray)[own]
    gx = (_near(dx, 0, -1) + 2 * dx + _near(dx, 0, 1))[own]
    gy = (_near(sx, 0, 1) - _near(sx, 0, -1))[own]
    there = ~np.isnan(gray[own])
    return int(there.sum()), float(lap[there].sum()), float((lap[there] ** 2).sum()), float((gx[there] ** 2 + gy[there] ** 2).sum())


def stencils(pixels: DataFrame, band: int = BAND) -> DataFrame:
    """(frame_id, laplacian, tenengrad, sharpness): variance of the Laplacian and mean Sobel energy; edges reflect.

    The pixels of a frame, or of a band of a tall one, come together once, as one row of lists; all neighbours are then
    taken from one matrix, and bands are summed up.
    """
    kind = pixels.schema["frame_id"].dataType.simpleString()
    at = F.floor(F.col("y") / band)
    bands = F.array_compact(F.array(at, F.when((F.col("y") % band == 0) & (F.col("y") > 0), at - 1), F.when(F.col("y") % band == band - 1, at + 1)))
    rows = pixels.select("frame_id", F.explode(bands).alias("_band"), F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("gray").cast("double").alias("g")).alias("p"))
    rows = rows.groupBy("frame_id", "_band").agg(F.collect_list("p").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for one, lists in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                y, x, g = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "g"))
                top, first = int(y.min()), int(x.min())
                gray = np.full((int(y.max()) - top + 1, int(x.max()) - first + 1), np.nan)
                gray[y - top, x - first] = g
                line = np.arange(len(gray)) + top
                sums.append(stencil_sums(gray, line // band == one))
            n, a, q, e = (pa.array(c) for c in zip(*sums, strict=True)) if sums else [pa.array([], t) for t in (pa.int64(), *[pa.float64()] * 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), n, a, q, e], ["frame_id", "n", "a", "q", "e"])

    out = rows.mapInArrow(run, f"frame_id {kind}, n long, a double, q double, e double").groupBy("frame_id").agg(*(F.sum(c).alias(c) for c in ("n", "a", "q", "e"))).filter("n > 0")
    mean = F.col("a") / F.col("n")
    out = out.select("frame_id", F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean).alias("laplacian"), (F.col("e") / F.col("n")).alias("tenengrad"))
    return out.withColumn("sharpness", sharpness(F.col("laplacian"), F.col("tenengrad")))
