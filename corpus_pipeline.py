"""The corpus pipeline: five stages, each written as Parquet and read again before the next.

A stage's frame reads scratch tables; they are deleted when the next stage begins
with an input that was read from elsewhere, so they don't add up.

Defined cases, beyond those of the operators: rows with a null doc_id and rows that
repeat are judged each for itself, and null and empty texts are documents like
others: toxicity scores them by the bias, exact dedup keeps one of all that are
blank, and near-dedup keeps it apart from texts with words.  Of equal or near texts
one row stays (exact dedup: the longest, then the smallest doc_id; near-dedup: the
smallest doc_id; nulls last).  A null source is a source of the mix.  Other columns
pass through to the last stage, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionquarry import storage
from ionquarry.llm import exact_dedup, mixing, packing, simhash, toxicity
from ionquarry.llm._common import table, written

#: Scratch tables that the latest call of each stage has left, by the stage's place.
_LEFT: dict[int, list[str]] = {}


def _remove(spark: SparkSession, place: int) -> None:
    for uri in _LEFT.pop(place, []):
        storage.remove(spark, uri)


def stage(place: int) -> Callable:
    """The stage at this place: it begins by deleting what the one before has left, unless its input still reads that."""

    def put(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        @functools.wraps(step)
        def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if not any("/ionquarry-" in f for f in docs.inputFiles()):
                _remove(spark, place - 1)
            before = len(storage.MADE)
            out = step(spark, docs, sf_dir)
            _LEFT[place] = storage.MADE[before:]
            return out

        return call

    return put


@stage(0)
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from the labelled documents among the input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


@stage(1)
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts that are equal but for white space."""
    return exact_dedup.dedup(docs)


@stage(2)
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked over five-word shingles: by SimHash, and at a similarity of 0.8 or more."""
    return simhash.near_dedup(docs, words=5)


@stage(3)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


@stage(4)
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 ids."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learnt weights, tokenizers and balanced sampling have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (name, step) in enumerate(STAGES):
        done = written(step(spark, docs, sf_dir), name.replace(" ", "-"))
        _remove(spark, place)
        docs = done
    return docs
