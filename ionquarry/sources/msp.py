"""MSP spectra files: records of "Name: value" lines and peaks, a blank line between records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text
from .mgf import canonical

#: Other names of our fields in such files (fixed values).
ALIASES = {
    "precursor_mz": ("precursormz", "precursor m/z"), "ionmode": ("ion_mode",), "adduct": ("precursor_type", "precursortype"),
    "instrument_type": ("instrumenttype",), "collision_energy": ("collisionenergy", "collision energy"),
}
_PEAK = r"^[-+.\dEe]+[\s,]+[-+.\dEe]+([\s;]|$)"


def read_raw(spark: SparkSession, files: list[str], first: int = 0) -> DataFrame:
    """(pos, file, params, peaks); several peaks of a line are parted by ";", what follows a peak's two numbers is ignored.

    Files are split at blank lines.  A file with other line ends than "\\n" is one
    record to the reader and is cut afterwards, by one task; records are then
    numbered within it.
    """
    found = text.records(spark, files, "\n\n", first)
    cut = found.select("pos", "file", F.posexplode(F.split("value", "\r?\n[ \t]*\r?\n")).alias("i", "value"))
    rows = cut.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").withColumn("pos", F.col("pos") + F.col("i"))
    rows = rows.withColumn("lines", text.lines(F.col("value")))
    is_peak = lambda x: F.regexp_like(x, F.lit(_PEAK))
    each = F.flatten(F.transform(F.filter("lines", is_peak), lambda x: F.transform(F.split(x, ";"), lambda p: F.trim(p))))
    params = text.pairs(F.filter("lines", lambda x: ~is_peak(x)), ":")
    return rows.select("pos", "file", params.alias("params"), text.peaks(F.filter(each, is_peak)).alias("peaks"))


def read(spark: SparkSession, paths: str | list[str], aliases: dict = ALIASES) -> DataFrame:
    """The canonical spectra table, ``pos`` in the order of the files and of their records."""
    return canonical(read_raw(spark, text.files_in_order(spark, paths)), aliases)
