"""Joins of rows with an aggregate of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def joined_back(rows: DataFrame, summary: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``summary``, a row a key made by an aggregate or a join on ``keys``.

    Such a summary already lies by its keys, so the join would run in the stage
    that makes it, which adaptive execution can't split.  Dealt out anew, without
    a key, it meets the rows by a shuffle of its own, and with a plain shuffle on
    both sides the rows of a hot key are split among tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(summary.repartition(parts), keys, how)
