"""Sparse fingerprints: layout, scaling and weights, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prepared(counts: Column, scaling: str | None = None, weights: dict[int, float] | None = None) -> Column:
    """STRUCT<bits, values> of a map bit -> count, sorted by bit.

    ``scaling``: None or "log" (ln(1 + count)); ``weights``: factor by bit, 1
    where it names none.  Other scalings raise ``ValueError``, other weights
    ``TypeError``.
    """
    if scaling not in (None, "log"):
        raise ValueError(f"unknown scaling {scaling!r}: use 'log' or None")
    if weights is not None and not isinstance(weights, dict):
        raise TypeError("weights must be a dict from bit to factor")
    pairs = F.array_sort(F.map_entries(counts))

    def value(p: Column) -> Column:
        v = F.log1p(p["value"].cast("double")) if scaling == "log" else p["value"].cast("double")
        if weights:
            table = F.map_from_arrays(F.lit([int(b) for b in weights]).cast("array<bigint>"), F.lit([float(w) for w in weights.values()]).cast("array<double>"))
            v = v * F.coalesce(F.try_element_at(table, p["key"].cast("long")), F.lit(1.0))
        return v.cast("float")

    return F.struct(F.transform(pairs, lambda p: p["key"].cast("long")).alias("bits"), F.transform(pairs, value).alias("values"))


def scaled_dense(counts: Column, scaling: str | None = None, weights: list[float] | None = None) -> Column:
    """A dense count fingerprint, scaled and weighted by position."""
    if scaling not in (None, "log"):
        raise ValueError(f"unknown scaling {scaling!r}: use 'log' or None")
    out = F.transform(counts, lambda c: F.log1p(c.cast("double")) if scaling == "log" else c.cast("double"))
    if weights is not None:
        out = F.zip_with(out, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    return F.transform(out, lambda x: x.cast("float"))


def exploded(fps: DataFrame, key: str, bits: str = "fp_bits", values: str = "fp_values") -> DataFrame:
    """(key, bit, value): a row per bit; without values each counts 1.  Null fingerprints give no rows."""
    has = F.col(values).isNotNull() & (F.size(values) > 0) if values in fps.columns else F.lit(False)
    ones = F.transform(F.col(bits), lambda _: F.lit(1.0).cast("float"))
    filled = F.when(has, F.col(values)).otherwise(ones) if values in fps.columns else ones
    pairs = fps.select(key, F.explode(F.arrays_zip(F.col(bits).alias("bit"), filled.alias("value"))).alias("p"))
    return pairs.select(key, F.col("p.bit").alias("bit"), F.col("p.value").cast("double").alias("value"))


def from_dense(dense: Column) -> Column:
    """STRUCT<bits, values> of the non-zero positions of a dense fingerprint."""
    at = F.filter(F.transform(dense, lambda x, i: F.struct(i.cast("long").alias("bit"), x.cast("float").alias("value"))), lambda p: p["value"] != 0)
    return F.struct(F.transform(at, lambda p: p["bit"]).alias("bits"), F.transform(at, lambda p: p["value"]).alias("values"))


def stored(sparse: bool, fp: Column) -> Column:
    """What a compound table of this layout takes; a sparse fingerprint in a dense table raises."""
    kind = "struct" if sparse else "array"
    return F.when(F.typeof(fp).startswith(kind), fp).otherwise(F.raise_error(F.lit(f"this table takes {kind} fingerprints")))
