"""What the writers do to tables, as frame to frame operators: insert or ignore, upsert, replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.keys import inchikey14, valid_key
from .aggregate import kept

#: Names under which a 14-character key is found, and the fields of a compound (fixed values).
KEY_ALIASES = ("nchikey", "inchikey14", "inchikey_14", "ik14", "comp_id")
COMPOUND_FIELDS = ("inchikey", "smiles", "inchi", "classyfire_class", "classyfire_superclass")


def absent_rows(existing: DataFrame, new: DataFrame, key: str, pos: str) -> DataFrame:
    """The rows to append: the first of each key in ``new`` that ``existing`` lacks."""
    return kept(new, key, pos, last=False).join(existing.select(key), key, "left_anti")


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str, pos: str) -> DataFrame:
    """``existing`` with the new rows whose key it lacks; the first writer wins."""
    return existing.unionByName(absent_rows(existing, new, key, pos).select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, key: str, pos: str | None = None) -> DataFrame:
    """Per column a new value wins unless it is null or, for arrays, empty.

    ``pos`` orders several new rows of one key; later ones win column by column.
    """
    columns = [c for c in existing.columns if c != key]
    arrays = {f.name for f in existing.schema if isinstance(f.dataType, ArrayType)}
    given = lambda c: F.when(F.size(c) > 0, F.col(c)) if c in arrays else F.col(c)
    have = [c for c in columns if c in new.columns]
    if pos:
        new = new.groupBy(key).agg(*[F.max_by(given(c), F.when(given(c).isNotNull(), F.col(pos))).alias(c) for c in have])
    else:
        new = new.select(key, *[given(c).alias(c) for c in have])
    fresh = new.select(key, *[F.col(c).alias(f"_{c}") for c in have])
    merged = existing.join(fresh, key, "full_outer")
    return merged.select(key, *[(F.coalesce(f"_{c}", c) if c in have else F.col(c)).alias(c) for c in columns])


def replace_by_key(existing: DataFrame, new: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows of ``new`` replace those of ``existing`` with the same key; the last one wins."""
    last = kept(new, key, pos).select(*existing.columns)
    return existing.join(last.select(key), key, "left_anti").unionByName(last)


def links(existing: DataFrame, pairs: DataFrame, pos: str = "pos") -> DataFrame:
    """The spectrum to compound map with ``pairs`` put in; a key of another length raises."""
    message = F.concat(F.lit("not a 14-character key: "), F.coalesce("comp_id", F.lit("null")))
    checked = pairs.withColumn("comp_id", F.when(valid_key(F.col("comp_id")), F.col("comp_id")).otherwise(F.raise_error(message).cast("string")))
    checked = checked.withColumn("spec_id", F.col("spec_id").cast("string"))
    return replace_by_key(existing, checked, "spec_id", pos)


def compound_rows(frame: DataFrame, mapper: dict[str, str] | None = None) -> DataFrame:
    """Any wide frame as (comp_id, inchikey, smiles, inchi, classes), rows in their order kept as ``pos`` if it is there.

    ``mapper``: our name -> theirs.  A 14-character key column is found by its
    aliases, else derived from the full key; neither raises ``ValueError``.
    """
    mapper = mapper or {}
    key = mapper.get("comp_id") or next((c for c in KEY_ALIASES if c in frame.columns), None)
    full = mapper.get("inchikey", "inchikey")
    full = full if full in frame.columns else None
    if key is not None and key in frame.columns:
        comp = F.trim(F.col(key).cast("string"))
    elif full:
        comp = inchikey14(F.trim(F.col(full).cast("string")))
    else:
        raise ValueError("the frame needs a 14-character key (mapper['comp_id']) or a full one (mapper['inchikey'])")
    out = [comp.alias("comp_id"), (F.trim(F.col(full).cast("string")) if full else F.lit(None).cast("string")).alias("inchikey")]
    for c in COMPOUND_FIELDS[1:]:
        source = mapper.get(c, c)
        out.append((F.col(source).cast("string") if source in frame.columns else F.lit(None).cast("string")).alias(c))
    return frame.select(*out, *(["pos"] if "pos" in frame.columns else []))


def overwrite_compounds(frame: DataFrame, mapper: dict[str, str] | None = None, pos: str = "pos") -> DataFrame:
    """The new compound table: valid keys only, the last row of each key."""
    rows = compound_rows(frame, mapper)
    return kept(rows.where(valid_key(F.col("comp_id"))), "comp_id", pos).drop(pos)


def overwrite_stats(frame: DataFrame, mapper: dict[str, str] | None = None) -> DataFrame:
    """(rows, valid, written, skipped); ``valid`` counts distinct keys."""
    comp = compound_rows(frame, mapper).select("comp_id")
    good = valid_key(F.col("comp_id"))
    return comp.agg(
        F.count("*").alias("rows"),
        F.countDistinct(F.when(good, F.col("comp_id"))).alias("valid"),
        F.countDistinct(F.when(good, F.col("comp_id"))).alias("written"),
        F.coalesce(F.sum((~good).cast("long")), F.lit(0)).alias("skipped"),
    )


def mapping_rows(spectra: DataFrame) -> DataFrame:
    """(spec_id, comp_id, accepted) of annotated spectra; keys of another length aren't accepted."""
    keyed = spectra.select(F.col("spec_id").cast("string").alias("spec_id"), inchikey14(F.col("inchikey")).alias("comp_id"))
    return keyed.where("comp_id is not null").withColumn("accepted", valid_key(F.col("comp_id")))


def missing_compounds(spectra: DataFrame, compounds: DataFrame, pos: str = "pos") -> DataFrame:
    """Compound rows for mapped spectra whose compound isn't known, from the first spectrum of each."""
    keyed = spectra.withColumn("comp_id", inchikey14(F.col("inchikey"))).where(valid_key(F.col("comp_id")))
    have = [c for c in ("smiles", "inchi", "inchikey", "classyfire_class", "classyfire_superclass") if c in spectra.columns]
    first = keyed.groupBy("comp_id").agg(F.min_by(F.struct(*have), F.col(pos)).alias("f")).select("comp_id", *[F.col("f")[c].alias(c) for c in have])
    return first.join(compounds.select("comp_id"), "comp_id", "left_anti")
