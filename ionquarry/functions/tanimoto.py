"""Generalised (min/max) Tanimoto similarity as column expressions.

``empty`` says what two empty fingerprints give: null, 1.0 or 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import FLOOR


def _ratio(low: Column, high: Column, empty: float | None) -> Column:
    return F.when(high > 0, low / high).otherwise(F.lit(empty).cast("double"))


def tanimoto_dense(a: Column, b: Column, weights: Column | None = None, empty: float | None = None) -> Column:
    """Sum of minima over sum of maxima, each times its weight."""
    low = F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double"))
    high = F.zip_with(a, b, lambda x, y: F.greatest(x, y).cast("double"))
    if weights is not None:
        low, high = (F.zip_with(v, weights, lambda x, w: x * w.cast("double")) for v in (low, high))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return _ratio(add(low), add(high), empty)


def tanimoto_from_minimum(minimum: Column, l1_a: Column, l1_b: Column) -> Column:
    """From the sum of minima and both L1 norms; a union of 0 or less counts as 1e-12, so empty pairs give 0."""
    union = l1_a + l1_b - minimum
    return minimum / F.when(union > 0, union).otherwise(F.lit(FLOOR))


def tanimoto_from_manhattan(l1_a: Column, l1_b: Column, distance: Column) -> Column:
    """From both L1 norms and the Manhattan distance; an empty union gives 1."""
    union = l1_a + l1_b + distance
    return F.when(union <= 0, F.lit(1.0)).otherwise((l1_a + l1_b - distance) / union)


def tanimoto_sparse(bits_a: Column, values_a: Column, bits_b: Column, values_b: Column, empty: float | None = None) -> Column:
    """Of two sparse fingerprints in one row, through a map of the second."""
    other = F.map_from_arrays(bits_b, values_b)
    pairs = F.zip_with(bits_a, values_a, lambda k, v: F.least(v.cast("double"), F.coalesce(F.try_element_at(other, k).cast("double"), F.lit(0.0))))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    low = add(pairs)
    return _ratio(low, add(values_a) + add(values_b) - low, empty)
