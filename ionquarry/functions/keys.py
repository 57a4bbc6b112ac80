"""Keys and metadata values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KEY_LENGTH, METADATA_FIELDS


def inchikey14(key: Column) -> Column:
    """First block of an InChIKey, trimmed and upper-cased.

    Null or empty gives null.  With a hyphen: what stands before the first one,
    cut to 14 characters (it may be shorter).  Without: the first 14, or null if
    there are fewer.
    """
    text = F.upper(F.trim(key))
    return (
        F.when(key.isNull() | (key == ""), F.lit(None).cast("string"))
        .when(F.instr(text, "-") > 0, F.left(F.split_part(text, F.lit("-"), F.lit(1)), F.lit(KEY_LENGTH)))
        .when(F.char_length(text) >= KEY_LENGTH, F.left(text, F.lit(KEY_LENGTH)))
    )


def valid_key(key: Column) -> Column:
    """Whether a compound key has the length that the map demands; null counts as not."""
    return F.coalesce(F.char_length(key) == KEY_LENGTH, F.lit(False))


def absent(value: Column) -> Column:
    """Stored form of a text field: empty is null, all else is text as it is."""
    return F.nullif(value.cast("string"), F.lit(""))


def clean(value: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def number(value: Column) -> Column:
    """A real, or null if it can't be read or is NaN."""
    real = value.cast("string").try_cast("double")
    return F.when(~F.isnan(real), real)


def meta(params: Column, key: str, default: str | None = None) -> Column:
    """A field of a metadata map, or the default."""
    found = F.try_element_at(params, F.lit(key))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def normalized_metadata(params: Column, fields: tuple = METADATA_FIELDS, aliases: dict | None = None) -> list[Column]:
    """One column for each field, from a map with lower-case keys; ``aliases``: other names of a field.

    The precursor's m/z may be followed by its intensity; the first number counts.
    """
    out = []
    for f in fields:
        value = F.coalesce(*[meta(params, k) for k in (f, *(aliases or {}).get(f, ()))])
        out.append((number(F.regexp_extract(value, r"^\s*(\S+)", 1)) if f == "precursor_mz" else absent(value)).alias(f))
    return out


def present(value: Column) -> Column:
    """Not null and not blank."""
    return value.isNotNull() & (F.trim(value) != "")


def strip_where(condition: str) -> str:
    """A condition given with or without the word WHERE."""
    text = condition.strip()
    return text[6:].strip() if text[:6].upper() == "WHERE " else text
