"""Stored neighbour indexes of vectors: cells around centroids, with an exact and a probing search.

``build`` fits the centroids to a sample of at most ``SAMPLE`` vectors, deals every
unit vector to its nearest centroid and writes the table in order of cells, so a
search of some cells prunes the rest by Parquet's statistics.  With ``probes`` a
query looks into that many cells with the nearest centroids; without it into all,
which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .lookup import one_dimension
from .topk import DIGITS, _unit, dense, ranked

#: Vectors the centroids are fitted to at most, rows of a cell in the mean, most cells, and rounds of the fit.
SAMPLE, CELL, MOST_CELLS, ROUNDS, SEED = 20_000, 2_000, 4_096, 10, 7


class NeighbourIndex(Protocol):
    """What a library's search asks of an index."""

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_ix, rank, id, score) for ``queries(query_ix, vec)``."""

    @property
    def size(self) -> int: ...


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids by spherical k-means; a cell that empties keeps its centroid."""
    rng = np.random.default_rng(SEED)
    found = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        found = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), found)
    return found


def _cells(rows: DataFrame, key: str, middles: np.ndarray, probes: int) -> DataFrame:
    """(key, vec, cell): each vector, scaled to length 1, with its ``probes`` nearest cells; the middles are bounded by ``MOST_CELLS``."""
    shared = rows.sparkSession.sparkContext.broadcast(middles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                n = min(probes, len(shared.value))
                near = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :n]
                at = np.repeat(np.arange(b.num_rows), n)
                unit = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * x.shape[1], pa.array(x[at].ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), unit, pa.array(near.ravel().astype(np.int32))], names=[key, "vec", "cell"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, f"{key} {kind}, vec array<double>, cell int")


def build(embeddings: DataFrame, item: str = "spec_id", vec: str = "vec", cells: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(item, vec, cell) of every unit vector, and the centroids.  No rows or vectors of several lengths raise ``ValueError``."""
    one_dimension(embeddings, vec, may_be_empty=False)
    rows = embeddings.select(item, F.col(vec).alias("vec"))
    n = rows.count()
    cells = cells or min(MOST_CELLS, max(1, n // CELL))
    some = rows.select("vec") if n <= SAMPLE else rows.orderBy(F.xxhash64(item, F.lit(SEED))).select("vec").limit(SAMPLE)
    middles = centroids(_unit(np.array([r[0] for r in some.collect()], dtype=np.float64)), cells)
    return _cells(rows, item, middles, 1), middles


class VectorIndex:
    """A built index: ``rows(item, vec, cell)`` and its centroids."""

    def __init__(self, rows: DataFrame, middles: np.ndarray, item: str = "spec_id", probes: int | None = None):
        self.rows, self.middles, self.item, self.probes = rows, middles, item, probes

    @property
    def size(self) -> int:
        return self.rows.count()

    def query(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_ix, rank, item, score) by cosine; queries of another length raise ``ValueError``."""
        probes = probes or self.probes
        if probes is None or probes >= len(self.middles):
            return dense(queries, self.rows, k, item=self.item)
        if (d := one_dimension(queries)) not in (None, self.middles.shape[1]):
            raise ValueError(f"dimensions differ: queries {d}, library {self.middles.shape[1]}")
        asked = queries.select(F.col("query_ix").cast("long").alias("query_ix"), "vec")
        near = _cells(asked, "query_ix", self.middles, probes).withColumnRenamed("vec", "q")
        found = near.join(self.rows, "cell").select("query_ix", self.item, F.round(dot(F.col("q"), F.col("vec")), DIGITS).alias("score"))
        return ranked(found, k, "query_ix", self.item).select("query_ix", "rank", self.item, "score")
