"""Records of text files, numbered in the order of the files and of the records in them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a place within a file.
WITHIN = 44


def files_in_order(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """All files of the given paths, as encoded URIs: path after path, those of a folder or pattern by name."""
    given = [paths] if isinstance(paths, str) else list(paths)
    return [re.sub("^(\\w+):///", r"\1:/", f) for p in given for f in sorted(spark.read.text(p).inputFiles())]


def records(spark: SparkSession, files: list[str], line_sep: str, first: int = 0) -> DataFrame:
    """(pos, file, value): each file's records, cut at ``line_sep``; ``pos`` rises through the files as listed.

    A file is read by many tasks.  Within a file a record's place is the start
    of its task's block plus its number among the task's rows, which is smaller
    than the block is long, so places rise through the blocks.  ``first`` is the
    number of the first file.
    """
    listed = spark.createDataFrame([(f, first + i) for i, f in enumerate(files)], "path string, ix long")
    plain = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)).toString() for f in files]
    rows = spark.read.option("lineSep", line_sep).text(plain).select(
        F.regexp_replace("_metadata.file_path", "^(\\w+):///", "$1:/").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"),
    )
    rows = rows.join(F.broadcast(listed), F.col("file") == F.col("path"))  # a row a file
    return rows.select((F.shiftleft("ix", WITHIN) + F.col("block") + F.col("row")).alias("pos"), "file", "value")


def lines(body):
    """The lines of a record that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(body, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def pairs(found, sep: str):
    """A map of the lines that have ``sep`` after a name: names in lower case, the last of a repeated name counts."""
    named = F.transform(
        F.filter(found, lambda x: F.instr(x, sep) > 1),
        lambda x: F.struct(F.lower(F.trim(F.substring_index(x, sep, 1))).alias("key"), F.trim(F.substr(x, F.instr(x, sep) + len(sep))).alias("value")),
    )
    put = lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"]))
    return F.aggregate(named, F.expr("cast(map() as map<string,string>)"), put)


def peaks(found):
    """Peaks, by m/z, of lines that begin with two numbers; those that can't be read are left out."""
    split = F.transform(found, lambda x: F.split(x, r"[\s,]+"))
    both = F.transform(split, lambda p: F.struct(p[0].try_cast("double").alias("mz"), F.get(p, F.lit(1)).try_cast("double").alias("intensity")))
    return F.array_sort(F.filter(both, lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull()))
