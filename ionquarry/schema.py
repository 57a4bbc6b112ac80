"""Canonical schemas."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, D, I, L = StringType(), DoubleType(), IntegerType(), LongType()
PEAK = _struct(mz=D, intensity=D)
PEAKS = ArrayType(PEAK)
#: Text metadata of a spectrum (fixed values); precursor_mz is its only number.
TEXT_FIELDS = ("ionmode", "smiles", "inchikey", "inchi", "name", "charge", "instrument_type", "adduct", "collision_energy")
METADATA_FIELDS = ("precursor_mz", *TEXT_FIELDS)
#: Consensus metadata: taken from a cluster's first spectrum, and combined over all (fixed values).
FROM_FIRST = ("ionmode", "smiles", "inchikey", "inchi", "name", "precursor_mz", "charge")
COMBINED = ("instrument_type", "adduct", "collision_energy")

SPECTRA = _struct(spec_id=S, peaks=PEAKS, n_peaks=I, precursor_mz=D, **dict.fromkeys(TEXT_FIELDS, S))
COMPOUNDS = _struct(
    comp_id=S, smiles=S, inchi=S, inchikey=S, fp_bits=ArrayType(L), fp_values=ArrayType(FloatType()),
    fp_dense=ArrayType(FloatType()), classyfire_class=S, classyfire_superclass=S,
)
SPEC_TO_COMP = _struct(spec_id=S, comp_id=S)
EMBEDDINGS = _struct(spec_id=S, d=I, vec=ArrayType(FloatType()))
HISTOGRAM = MapType(S, L)
MERGED_SPECTRA = _struct(
    comp_id=S, ionmode=S, charge=S, precursor_mz=D, smiles=S, inchikey=S, inchi=S, name=S, instrument_type=S, adduct=S,
    collision_energy=S, num_merged=I, source_spec_ids=ArrayType(S), peaks=PEAKS, instrument_type_hist=HISTOGRAM,
    adduct_hist=HISTOGRAM, collision_energy_hist=HISTOGRAM,
)
MERGED_EMBEDDINGS = _struct(merged_id=L, embedding=ArrayType(FloatType()))
KEY_LENGTH = 14
