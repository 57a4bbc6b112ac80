"""Compound tables in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators by suffix (fixed values).
SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with ``pos`` in row order; other suffixes raise ``ValueError``."""
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    if suffix not in SEPARATORS:
        raise ValueError(f"compound files end in {', '.join(SEPARATORS)}, not {suffix}")
    frame = spark.read.option("header", True).option("sep", SEPARATORS[suffix]).option("escape", '"').csv(path)
    return frame.withColumn("pos", F.monotonically_increasing_id())
