"""Vector arithmetic on ``array<float>`` columns, in double precision and in a fixed order of summation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def is_vector(a: Column, dimension: int) -> Column:
    """True for lists of ``dimension`` finite numbers; false for all else, null included."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dimension) & finite, F.lit(False))


def normalised(a: Column, least: float | None = 1e-12) -> Column:
    """Unit vector.  A norm below ``least`` is clamped to it; with None a zero vector is an error."""
    n = norm(a)
    by = F.greatest(n, F.lit(least)) if least is not None else F.when(n > 0, n).otherwise(F.raise_error(F.lit("zero vector")))
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(by, F.size(a)).alias("n")), lambda p: p["x"] / p["n"])


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector is null or zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(distance: Column) -> Column:
    return 1 - distance


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two histograms; 0 for empty or constant ones."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    centred = lambda v: F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(mean(v), F.size(v)).alias("m")), lambda p: p["x"] - p["m"])
    x, y = centred(a), centred(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.coalesce(F.try_divide(dot(x, y), norm(x) * norm(y)), F.lit(0.0))).otherwise(0.0)


def bhattacharyya(a: Column, b: Column) -> Column:
    """Bhattacharyya distance of two histograms, whatever their scale."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    overlap = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(overlap, F.sqrt(total(a) * total(b))), F.lit(0.0))))
