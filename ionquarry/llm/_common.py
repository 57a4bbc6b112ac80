"""Helpers of the operators: worker files, batches of bounded size, word hashes."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, release_shuffles, scratch, written

__all__ = ["WordIds", "discard", "numbered", "open_fs", "release_shuffles", "scratch", "shuffle_parts", "slices", "table", "trimmed", "written"]

#: Text bytes that a worker takes up at once; Spark bounds the bytes of an Arrow batch (maxBytesPerBatch).
BYTES = 8 << 20


#: Parameters of the C library's mallopt (fixed values).
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3


def open_fs(uri: str):
    """(filesystem, path) for a URI, on any executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A table of the rows with ``name``, numbers from 0 without gaps in the order of partitions and rows."""
    held = written(df.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    firsts, at = [], 0
    for p, n in sorted(held.groupBy(part.alias("p")).count().collect()):  # a row a partition
        firsts += [F.lit(p), F.lit(at)]
        at += n
    base = F.element_at(F.create_map(*firsts), part) if firsts else F.lit(0)
    out = held.withColumn(name, (base + F.col("__at").bitwiseAND(2**33 - 1)).cast("long")).drop("__at")
    out._ionquarry_uri = held._ionquarry_uri
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a string or binary column, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, before + most, side="right")) - at)
        yield batch.slice(at, n)
        at += n


@functools.cache
def _lean() -> None:
    """From now on, blocks of 1 MB and more go back to the system as soon as they are freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(M_MMAP_THRESHOLD, 1 << 20)
        libc.mallopt(M_TRIM_THRESHOLD, 1 << 20)
    except (OSError, AttributeError):  # another C library
        pass


def _give_back() -> None:
    """Return freed memory to the system: workers live on between tasks beside the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable) -> Callable:
    """A worker function that gives memory back when its task ends."""

    @functools.wraps(run)
    def call(batches: Iterator) -> Iterator:
        _lean()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return call


class WordIds(dict):
    """word (bytes) -> 64-bit hash, computed once per distinct word.

    The memo is emptied when it reaches ``bound`` entries, so memory is bounded
    whatever the vocabulary; values do not depend on it.
    """

    def __init__(self, seed: int = 0, bound: int = 200_000):
        import xxhash

        super().__init__()
        self._hash, self._seed, self._bound = xxhash.xxh3_64_intdigest, seed, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._bound:
            self.clear()
        value = self[word] = self._hash(word, self._seed)
        return value
