"""Keyed lookups and joins.

A request is a list of ids in order.  It becomes a small frame (pos, key); Spark
decides from its size whether to broadcast it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalized, peaks_f32
from ..schema import METADATA_FIELDS


def request(spark: SparkSession, ids: Sequence[str] | DataFrame, key: str = "spec_id") -> DataFrame:
    """(pos, key) of requested ids; a frame with those columns passes through."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col("pos").cast("long").alias("pos"), F.col(key).cast("string").alias(key))
    return spark.createDataFrame([(i, None if x is None else str(x)) for i, x in enumerate(ids)], f"pos long, {key} string")


def in_request_order(table: DataFrame, asked: DataFrame, key: str = "spec_id") -> DataFrame:
    """Requested rows in order: missing ids are skipped, repeated ones repeated."""
    return asked.join(table, key).orderBy("pos")


def row_for_each(table: DataFrame, asked: DataFrame, key: str = "spec_id") -> DataFrame:
    """A row per requested id in order; missing ids have nulls."""
    return asked.join(table, key, "left").orderBy("pos")


def last_position(table: DataFrame, asked: DataFrame, key: str = "comp_id") -> DataFrame:
    """Requested rows once each, in order of their last request; missing ids are left out."""
    once = asked.groupBy(key).agg(F.max("pos").alias("pos"))
    return once.join(table, key).orderBy("pos")


def spectra_by_ids(spectra: DataFrame, asked: DataFrame) -> DataFrame:
    return in_request_order(spectra, asked)


def fragments_by_ids(spectra: DataFrame, asked: DataFrame, single: bool = False) -> DataFrame:
    """(pos, spec_id, peaks), in single precision if asked for."""
    return in_request_order(spectra.select("spec_id", (peaks_f32(F.col("peaks")) if single else F.col("peaks")).alias("peaks")), asked)


def metadata_by_ids(spectra: DataFrame, asked: DataFrame, fields: Sequence[str] = METADATA_FIELDS) -> DataFrame:
    return row_for_each(spectra.select("spec_id", *having(spectra, fields)), asked)


def embeddings_by_ids(embeddings: DataFrame, asked: DataFrame | None = None, normalized: bool = True) -> DataFrame:
    """(spec_id, vec) sorted by id: repeated requests collapse, missing ids are left out.

    Vectors of several lengths raise ``ValueError``.
    """
    found = embeddings if asked is None else embeddings.join(asked.select("spec_id").distinct(), "spec_id", "left_semi")
    one_dimension(found)
    vec = l2_normalized(F.col("vec")) if normalized else F.col("vec")
    return found.select("spec_id", vec.alias("vec")).orderBy("spec_id")


def one_dimension(embeddings: DataFrame, vec: str = "vec", may_be_empty: bool = True) -> int | None:
    """The length all vectors share; ``ValueError`` if they differ (or, if asked, if there are none)."""
    low, high = embeddings.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if low != high:
        raise ValueError(f"Mixed dimensions: {low} to {high}")
    if low is None and not may_be_empty:
        raise ValueError("No rows")
    return low


def fingerprints_by_ids(compounds: DataFrame, asked: DataFrame) -> DataFrame:
    """(pos, comp_id, fp_bits, fp_values, fp_dense) for each id; null where there is none."""
    return row_for_each(compounds.select("comp_id", "fp_bits", "fp_values", "fp_dense"), asked, "comp_id")


def compounds_by_ids(compounds: DataFrame, asked: DataFrame) -> DataFrame:
    """Compound metadata without fingerprints."""
    return last_position(compounds.drop("fp_bits", "fp_values", "fp_dense"), asked)


def compound(compounds: DataFrame, comp_id: str) -> dict | None:
    row = compounds.where(F.col("comp_id") == comp_id).drop("fp_bits", "fp_values", "fp_dense").first()
    return row.asDict() if row else None


def comp_ids_of_spectra(mapping: DataFrame, asked: DataFrame) -> DataFrame:
    """(spec_id, comp_id) of the mapped ones among the requested spectra."""
    return mapping.join(asked.select("spec_id"), "spec_id", "left_semi")


def spectra_of_comp_ids(mapping: DataFrame, asked: DataFrame) -> DataFrame:
    """(spec_id, comp_id) of all spectra of the requested compounds."""
    return mapping.join(asked.select("comp_id"), "comp_id", "left_semi").select("spec_id", "comp_id")


def metadata_by_comp_ids(mapping: DataFrame, spectra: DataFrame, asked: DataFrame, fields: Sequence[str] = METADATA_FIELDS) -> DataFrame:
    """(comp_id, spec_id, metadata) of all spectra of the requested compounds."""
    rows = spectra.select("spec_id", *having(spectra, fields))
    own = spectra_of_comp_ids(mapping, asked)
    return own.join(rows, "spec_id").select("comp_id", "spec_id", *having(rows, fields))


def without(table: DataFrame, done: DataFrame, key: str = "spec_id") -> DataFrame:
    """Rows whose key isn't in ``done``: what is still to be computed."""
    return table.join(done.select(key), key, "left_anti")


def with_external(table: DataFrame, external: DataFrame, key: str, external_key: str | None = None) -> DataFrame:
    """Left join of user metadata."""
    external_key = external_key or key
    if external_key == key:
        return table.join(external, key, "left")
    return table.join(external, F.col(key) == external[external_key], "left")


def having(table: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Those of the wanted columns that the table has."""
    return [F.col(c) for c in columns if c in table.columns]
