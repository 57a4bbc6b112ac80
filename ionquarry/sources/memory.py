"""Spectra and compounds given as Python values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import absent, number
from ..schema import PEAKS, TEXT_FIELDS
from .mgf import spectrum_id


def spectra_frame(spark: SparkSession, spectra: Mapping | Sequence[Mapping]) -> DataFrame:
    """(pos, spec_id, peaks, n_peaks, metadata) of one spectrum or several.

    A spectrum is a mapping with ``mz`` and ``intensities`` of equal length (else
    ``ValueError``) and any metadata fields.  Anything else raises ``ValueError``.
    """
    many = [spectra] if isinstance(spectra, Mapping) else spectra
    if not isinstance(many, Sequence) or isinstance(many, (str, bytes)) or not all(isinstance(s, Mapping) for s in many):
        raise ValueError("give a spectrum or a sequence of spectra, each a mapping with mz and intensities")
    rows = []
    for pos, s in enumerate(many):
        mz, intensity = list(s.get("mz", [])), list(s.get("intensities", []))
        if len(mz) != len(intensity):
            raise ValueError(f"spectrum {pos} has {len(mz)} m/z values and {len(intensity)} intensities")
        text = [None if s.get(f) is None else str(s[f]) for f in ("precursor_mz", *TEXT_FIELDS)]
        rows.append((pos, sorted((float(a), float(b)) for a, b in zip(mz, intensity, strict=True)), *text))
    fields = ", ".join(f"{f} string" for f in ("precursor_mz", *TEXT_FIELDS))
    df = spark.createDataFrame(rows, f"pos long, peaks {PEAKS.simpleString()}, {fields}")
    metadata = [number(F.col("precursor_mz")).alias("precursor_mz"), *[absent(F.col(f)).alias(f) for f in TEXT_FIELDS]]
    return df.select("pos", spectrum_id(F.col("peaks")).alias("spec_id"), "peaks", F.size("peaks").alias("n_peaks"), *metadata)
