"""Spectra files of any format that is read here, by suffix."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mgf, msp, text
from .mgf import canonical

#: Fields of a JSON record, with other names in use (fixed values).
JSON_ALIASES = {**mgf.ALIASES, "precursor_mz": ("precursor_mz", "pepmass")}


def read_json(spark: SparkSession, files: list[str], first: int = 0) -> DataFrame:
    """(pos, params, peaks) of JSON lines or of files that are one list: ``peaks_json``, a list of [m/z, intensity], and metadata fields."""
    found = text.records(spark, files, "\n", first).where("trim(value) not in ('', '[', ']')")
    whole = F.regexp_replace(F.trim("value"), r"^\[\s*(?=\{)|,$|(?<=\})\s*\]$", "")
    rows = F.from_json(F.concat(F.lit("["), whole, F.lit("]")), "array<map<string,string>>")
    rows = found.select("pos", "file", F.posexplode(rows).alias("i", "m"))
    params = F.map_from_entries(F.transform(F.map_entries("m"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    listed = F.from_json(F.try_element_at("m", F.lit("peaks_json")), "array<array<double>>")
    peaks = F.transform(F.filter(F.coalesce(listed, F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2), lambda p: F.struct(p[0].alias("mz"), p[1].alias("intensity")))
    return rows.select((F.col("pos") + F.col("i")).alias("pos"), params.alias("params"), F.array_sort(peaks).alias("peaks"))


#: Readers by suffix.
READERS = {"mgf": (mgf.read_raw, mgf.ALIASES), "msp": (msp.read_raw, msp.ALIASES), "json": (read_json, JSON_ALIASES), "jsonl": (read_json, JSON_ALIASES)}


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The canonical spectra table of files in any mix of formats, ``pos`` in their order; an unknown suffix raises ``ValueError``."""
    files = text.files_in_order(spark, paths)
    kinds = [f.rsplit(".", 1)[-1].lower() for f in files]
    if bad := sorted({k for k in kinds if k not in READERS}):
        raise ValueError(f"spectra files end in {', '.join(READERS)}, not {', '.join(bad)}")
    parts, at = [], 0
    for kind, run in groupby(zip(kinds, files, strict=True), key=lambda x: x[0]):
        own, (reader, aliases) = [f for _, f in run], READERS[kind]
        parts.append(canonical(reader(spark, own, at), aliases))
        at += len(own)
    return reduce(DataFrame.unionByName, parts)
