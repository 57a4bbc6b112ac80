"""MGF spectra files: one row per record, parsed with built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text
from ..functions.keys import normalized_metadata
from ..schema import METADATA_FIELDS

BEGIN, END = "BEGIN IONS", "END IONS"
#: Other names of our fields in such files (fixed values).
ALIASES = {"name": ("compound_name",), "precursor_mz": ("pepmass",), "instrument_type": ("source_instrument",), "collision_energy": ("collision_energy_ev",)}
_PEAK = r"^[-+.\dEe]+\s+[-+.\dEe]+(\s|$)"


def read_raw(spark: SparkSession, files: list[str], first: int = 0) -> DataFrame:
    """(pos, file, params, peaks): keys lower-cased and split at the first "=", peaks sorted by m/z.

    Files are split at the end of a record, so one file is read by many tasks.
    A peak line is two numbers; lines that are neither are ignored.  Of a
    repeated key the last value counts.
    """
    rows = text.records(spark, files, END, first).where(F.contains("value", F.lit(BEGIN)))
    rows = rows.withColumn("lines", text.lines(F.substring_index("value", BEGIN, -1)))
    is_peak = lambda x: F.regexp_like(x, F.lit(_PEAK))
    params = text.pairs(F.filter("lines", lambda x: ~is_peak(x)), "=")
    return rows.select("pos", "file", params.alias("params"), text.peaks(F.filter("lines", is_peak)).alias("peaks"))


def spectrum_id(peaks):
    """20 hex digits of the SHA-256 of the peaks, m/z to 5 and intensity to 5 digits: equal peaks, equal id."""
    shown = F.transform(peaks, lambda p: F.concat(F.format_number(p["mz"], 5), F.lit(":"), F.format_number(p["intensity"], 5)))
    return F.left(F.sha2(F.array_join(shown, ";"), 256), F.lit(20))


def canonical(raw: DataFrame, aliases: dict = ALIASES) -> DataFrame:
    """(pos, spec_id, peaks, n_peaks, metadata) of (pos, params, peaks): the canonical spectra table."""
    fields = normalized_metadata(F.col("params"), METADATA_FIELDS, aliases)
    return raw.select("pos", spectrum_id(F.col("peaks")).alias("spec_id"), "peaks", F.size("peaks").alias("n_peaks"), *fields)


def read(spark: SparkSession, paths: str | list[str], aliases: dict = ALIASES) -> DataFrame:
    """The canonical spectra table, ``pos`` in the order of the files and of their records."""
    return canonical(read_raw(spark, text.files_in_order(spark, paths)), aliases)
