"""Connected components of an edge table, distributed, in a few rounds.

Alternating large-star and small-star rounds: each points every node at the
smallest node it can see, until the edges are stars around the smallest node of
each component.  A hub's edges are only ever aggregated with map-side partial
minima or joined back to them (``joined_back``), where adaptive execution splits the hot side; no
neighbour list is gathered.  Each round is cut by a table in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, written
from .joins import joined_back


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = joined_back(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = joined_back(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of ``edges(u, v)`` that isn't its component's smallest.

    Loops and repeated edges are allowed, null ends are ignored, and no edges
    give an empty table.
    """
    one = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = written(one, "edges")
    seen = _signature(now)
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        after = written(_round(now), "edges")
        discard(now)
        now, before, seen = after, seen, _signature(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
