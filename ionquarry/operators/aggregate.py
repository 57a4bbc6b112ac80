"""Aggregations over spectra, compounds and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import clean, inchikey14


def unique_compounds(spectra: DataFrame, pos: str | None = None) -> DataFrame:
    """(inchikey14, n_spectra, inchikey): most spectra first, then by key.

    ``pos``: the column of the order by which the first full key is chosen
    (spec_id if there is none).
    """
    keyed = spectra.withColumn("inchikey14", inchikey14(F.col("inchikey"))).where("inchikey14 is not null")
    order = pos or "spec_id"
    return (
        keyed.groupBy("inchikey14")
        .agg(F.count("spec_id").alias("n_spectra"), F.min_by("inchikey", order).alias("inchikey"))
        .orderBy(F.desc("n_spectra"), "inchikey14")
    )


def vote(values: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """(key, mode, hist): the most frequent trimmed value and the counts of all; ties go to the greatest text.

    Blank values don't vote.  Two-step counts, so a large cluster is never gathered.
    """
    keys = [key] if isinstance(key, str) else key
    counted = values.select(*keys, clean(F.col(value)).alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(
        F.max_by("v", F.struct("n", "v")).alias("mode"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "n")))).alias("hist")
    )


def median_or_first(value: Column, pos: Column) -> Column:
    """Median of the readable numbers of a group, else its first value."""
    number = value.cast("string").try_cast("double")
    return F.coalesce(F.median(F.when(~F.isnan(number), number)), F.min_by(number, pos))


def document_frequency(bits: DataFrame, row: str = "row") -> DataFrame:
    """(bit, count, first_row) over (row, bit), by bit."""
    return bits.groupBy("bit").agg(F.count("*").alias("count"), F.min(row).alias("first_row")).orderBy("bit")


def idf(frequency: DataFrame, rows: int | Column) -> DataFrame:
    """ln(N / df) for each bit; a bit in no row counts as in one."""
    n = rows if isinstance(rows, Column) else F.lit(rows)
    return frequency.withColumn("idf", F.log(n.cast("double") / F.greatest(F.col("count"), F.lit(1))))


def idf_dense(rows: DataFrame, counts: str = "counts") -> DataFrame:
    """(bit, idf) over dense rows, bits that no row has included."""
    n = rows.count()
    each = rows.select(F.posexplode(counts).alias("bit", "v"))
    return each.groupBy("bit").agg(F.log(F.lit(float(n)) / F.greatest(F.sum((F.col("v") != 0).cast("int")), F.lit(1))).alias("idf"))


def coalesced(bits: DataFrame, key: str, dimension: int | None = None) -> DataFrame:
    """(key, bit, value) with repeated bits summed; a bit outside the dimension raises."""
    if dimension is not None:
        message = F.concat(F.lit("bit out of range: "), F.col("bit").cast("string"))
        bits = bits.withColumn("bit", F.when((F.col("bit") >= 0) & (F.col("bit") < dimension), F.col("bit")).otherwise(F.raise_error(message).cast("bigint")))
    return bits.groupBy(key, "bit").agg(F.sum("value").alias("value"))


def l1_norms(bits: DataFrame, key: str) -> DataFrame:
    return bits.groupBy(key).agg(F.sum(F.abs(F.col("value").cast("double"))).alias("l1"))


def merged_fingerprints(bits: DataFrame, group: str, fp: str, weights: DataFrame | None = None) -> DataFrame:
    """(group, bit, value): weighted mean of fingerprints, a bit that one lacks counting 0 for it.

    ``weights(group, fp, weight)``: 1 each if left out.  A group whose weights sum to 0 or less raises.
    """
    if weights is None:
        weights = bits.select(group, fp).distinct().withColumn("weight", F.lit(1.0))
    sums = weights.groupBy(group).agg(F.sum("weight").alias("total"))
    message = F.lit("weights must sum to more than 0")
    sums = sums.withColumn("total", F.when(F.col("total") > 0, F.col("total")).otherwise(F.raise_error(message).cast("double")))
    added = bits.join(weights, [group, fp]).groupBy(group, "bit").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
    return added.join(sums, group).select(group, "bit", (F.col("value") / F.col("total")).alias("value"))


def weighted_average_score(score: Column) -> Column:
    """Sum of squares over sum: the mean of scores weighted by themselves."""
    return F.sum(score * score) / F.sum(score)


def best_per_group(rows: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score of each group; ties go to the smaller ``tie``.  A partial aggregate, not a sort."""
    others = [c for c in rows.columns if c not in group]
    best = F.min_by(F.struct(*others), F.struct((-F.col(score)).alias("s"), F.col(tie)))
    return rows.groupBy(*group).agg(best.alias("best")).select(*group, "best.*")


def kept(rows: DataFrame, key: str, pos: str, last: bool = True) -> DataFrame:
    """One row of each key: the last (or first) by position."""
    order = F.desc(pos) if last else F.asc(pos)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def bit_positions(bits: DataFrame) -> DataFrame:
    """(bit, position): used bits numbered from 0 in order."""
    used = bits.select("bit").distinct()
    ranked = used.withColumn("bucket", F.shiftright("bit", 16))
    sizes = ranked.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per 65 536 bits
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("bit")) - 1
    return ranked.join(offsets, "bucket").select("bit", (place + F.col("before")).alias("position"))
