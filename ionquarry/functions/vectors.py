"""Arrays of numbers as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column) -> Column:
    """Scaled to length 1; lengths under 1e-12 count as that."""
    size = F.greatest(norm(v), F.lit(FLOOR))
    return F.transform(v, lambda x: x.cast("double") / size)


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def sum_normalized(peaks: Column) -> Column:
    """Intensities scaled to sum 1; unchanged if they sum to 0."""
    size = F.aggregate(peaks, F.lit(0.0), lambda s, p: s + p["intensity"])
    return F.transform(
        peaks, lambda p: F.struct(p["mz"].alias("mz"), F.when(size > 0, p["intensity"] / size).otherwise(p["intensity"]).alias("intensity"))
    )


def peaks_f32(peaks: Column) -> Column:
    """Peaks narrowed to single precision."""
    return F.transform(peaks, lambda p: F.struct(p["mz"].cast("float").alias("mz"), p["intensity"].cast("float").alias("intensity")))
