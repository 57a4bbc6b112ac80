"""Repeated passages: difference-cover anchors, then exact windows around them.

Words are maximal runs of characters other than ASCII white space.  A window is
``WINDOW`` (50) consecutive words of one document; a word is removed if a window
that covers it has a word sequence that also starts in a document with a smaller
doc_id, judged on the input.

1. Documents with one word sequence are told apart from the rest by its SHA-256;
   the smallest doc_id stands for them, and every word of the others goes.
2. Anchors are the ``GRAM``-word (20) sequences that start at positions p with
   p mod ``PERIOD`` (31) in the difference cover ``COVER``.  Every difference
   modulo the period is one of two cover positions, so if a window starts at i
   in one document and at j in another, some offset below the period puts both
   i + offset and j + offset on the cover; since 20 + 31 - 1 = 50, that anchor
   lies inside the window.  An anchor in one document only can't be in a match.
3. Matching anchors are extended: 128-bit hashes of all windows that contain one
   are compared, and the smallest doc_id of each hash decides.  Starts belong to
   a text, which has a number of its own: a doc_id may have several texts.

Groups are aggregated with map-side partial minima and joined back by
``joined_back``, where adaptive execution splits a hot key, so a passage in a
third of the documents is never gathered in one task; per-document lists are
bounded by the document's length.

Defined cases: null text has no words; texts under 50 words lose nothing; a null
doc_id comes after all others; rows that share a doc_id never remove words from
each other; other columns are ignored by ``removed`` and kept by ``dedup``; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WordIds, discard, numbered, release_shuffles, slices, trimmed, written
from ..operators.joins import joined_back

#: A perfect difference set: every non-zero residue mod 31 is one difference of it (fixed values).
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
WINDOW = 50
GRAM = WINDOW - PERIOD + 1
LAST = 2**63 - 1
#: Bits of a word's position within a text; a text has under 2^31 bytes.
AT_BITS = 31


class Rolling:
    """Hashes of all n-word sequences of a text, from prefix sums modulo 2^64."""

    def __init__(self, seed: int, base: int):
        self.ids, self.base = WordIds(seed), base
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            for name, b in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def windows(self, words: list[bytes], n: int) -> np.ndarray:
        if len(words) < n:
            return np.empty(0, dtype=np.uint64)
        self._grow(len(words) + 1)
        h = np.fromiter(map(self.ids.__getitem__, words), dtype=np.uint64, count=len(words))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.powers[: len(h)], dtype=np.uint64)])
        x = (sums[n:] - sums[:-n]) * self.inverse[: len(sums) - n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def on_cover(n: int) -> np.ndarray:
    """The anchor positions among n starts."""
    return np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling(1, 0x9E3779B97F4A7C15)
    for b in (s for batch in batches for s in slices(batch, 1)):
        counts, shas, hashes = [], [], []
        for text in b.column(1).to_pylist():
            words = split(text)
            counts.append(len(words))
            shas.append(hashlib.sha256(b" ".join(words)).digest())
            grams = rolling.windows(words, GRAM) if len(words) >= WINDOW else np.empty(0, np.uint64)
            hashes.append(grams[on_cover(len(grams))].view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int32)
        values = np.concatenate([np.empty(0, np.int64), *hashes])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.binary()), pa.ListArray.from_arrays(offsets, values)],
            names=["ord", "n_words", "sha", "anchors"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows that hold a matching anchor."""
    one, two = Rolling(1, 0x9E3779B97F4A7C15), Rolling(2, 0xC2B2AE3D27D4EB4F)
    for b in (s for batch in batches for s in slices(batch, 2)):
        for ord_, seq, text, hits in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            words = split(text)
            n = len(words) - WINDOW + 1
            spots = on_cover(len(words) - GRAM + 1)[np.unique(np.array(hits, dtype=np.int64))]
            edge = np.zeros(n + 1, dtype=np.int32)
            np.add.at(edge, np.maximum(spots - (PERIOD - 1), 0), 1)
            np.add.at(edge, np.minimum(spots, n - 1) + 1, -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(one.windows(words, WINDOW)[at].view(np.int64)),
                    pa.array(two.windows(words, WINDOW)[at].view(np.int64)),
                    pa.array(np.full(len(at), ord_)),
                    pa.array(np.full(len(at), seq)),
                    pa.array(at.astype(np.int32)),
                ],
                names=["h", "g", "ord", "seq", "at"],
            )


def covered(n_words: int, starts: list[int]) -> np.ndarray:
    """Which words lie in the windows with these starts."""
    edge = np.zeros(n_words + 1, dtype=np.int32)
    starts = np.unique(np.array(starts, dtype=np.int64))
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (s for batch in batches for s in slices(batch, 2)):
        removed, kept = [], []
        for text, starts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            words = split(text)
            gone = covered(len(words), starts)
            removed.append(int(gone.sum()))
            kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["rep", "sha", "rep_removed", "kept_text"],
        )


def _sha(text: str) -> Column:
    """SHA-256 of a text's words, joined by single spaces."""
    words = F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return F.unhex(F.sha2(words, 256))


def _analysed(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(a row per document: ord, doc_id, n_words, sha, rep), (cut texts: rep, sha, rep_removed, kept_text)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("ord"), F.col(f"`{text}`").alias("text")
    )
    whole = written(rows.mapInArrow(trimmed(_anchored), "ord long, n_words long, sha binary, anchors array<long>"), "anchored")
    # One row for each word sequence; equal sequences have equal anchors.
    reps = whole.where(f"n_words >= {WINDOW}").groupBy("sha").agg(F.min("ord").alias("rep"), F.first("anchors").alias("anchors"))
    reps = written(reps, "sequences")
    lead = reps.select("sha", "rep")
    each = written(whole.select("ord", "n_words", "sha").join(lead, "sha", "left"), "documents")
    discard(whole)
    release_shuffles(spark)
    spots = reps.select("rep", "sha", F.posexplode("anchors").alias("k", "h"))
    shared = spots.groupBy("h").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("h")
    hits = joined_back(spots, shared, "h").groupBy("rep", "sha").agg(F.collect_list("k").alias("hits"))
    hits = numbered(hits, "seq")
    discard(reps)
    release_shuffles(spark)
    found = rows.withColumn("own", _sha("text"))
    found = found.join(hits, (found["ord"] == hits["rep"]) & (found["own"] == hits["sha"]))
    near = written(found.select("ord", "seq", "text", "hits", "sha"), "near")
    discard(hits)
    release_shuffles(spark)
    windows = written(near.mapInArrow(trimmed(_windows), "h long, g long, ord long, seq long, at int"), "windows")
    # A start: the text's number and the position in one long, so that no more is shuffled than without the number.
    place = F.shiftleft("seq", AT_BITS).bitwiseOR(F.col("at").cast("long"))
    seq, at = F.shiftrightunsigned("place", AT_BITS), F.col("place").bitwiseAND((1 << AT_BITS) - 1).cast("int")
    # Half of the hashes at a time, so that half as much is shuffled at once.
    rounds = []
    for half in range(2):
        some = windows.where(F.shiftrightunsigned("g", 63) == half).select("h", "g", "ord", place.alias("place"))
        first = some.groupBy("h", "g").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").drop("hi")
        rounds.append(written(joined_back(some, first, ["h", "g"]).where("ord > lo").groupBy(seq.alias("seq")).agg(F.collect_set(at).alias("starts")), "starts"))
        release_shuffles(spark)
    discard(windows)
    starts = rounds[0].union(rounds[1]).groupBy("seq").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = joined_back(near.select("ord", "seq", "sha", "text"), starts, "seq").select("ord", "sha", "text", "starts")
    cut = cut.mapInArrow(trimmed(_cut), "rep long, sha binary, rep_removed long, kept_text string")
    cut = written(cut, "cut").dropDuplicates(["rep", "sha"])
    discard(near)
    release_shuffles(spark)
    return each, cut


def removed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): a row per row of ``docs``.

    ``kept_text`` is null where nothing is removed (the words are then all kept)
    and empty where everything is.
    """
    each, cut = _analysed(docs, text, doc_id)
    joined = joined_back(each, cut, ["rep", "sha"], "left")
    copy = F.coalesce(F.col("ord") > F.col("rep"), F.lit(False))
    gone = F.when(copy, F.col("n_words")).otherwise(F.coalesce("rep_removed", F.lit(0)))
    kept = F.when(copy, F.lit("")).otherwise(F.col("kept_text"))
    return joined.select(
        F.when(F.col("ord") < LAST, F.col("ord")).alias("doc_id"),
        "n_words",
        gone.cast("long").alias("n_removed"),
        F.coalesce(F.sha2(kept, 256), F.lower(F.hex("sha"))).alias("kept_sha256"),
        kept.alias("kept_text"),
    )


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with each text cut to its kept words; untouched texts stay as they are.

    Rows that share a doc_id are told apart by their word sequence.
    """
    each, cut = _analysed(docs, text, doc_id)
    joined = joined_back(each, cut, ["rep", "sha"], "left")
    copy = F.coalesce(F.col("ord") > F.col("rep"), F.lit(False))
    new = joined.where(copy | F.col("kept_text").isNotNull()).select(
        F.col("ord").alias("__ord"), F.hex("sha").alias("__sha"), F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("__kept")
    ).dropDuplicates(["__ord", "__sha"])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST))
    out = docs.select(whole, ident.alias("__o"), F.hex(_sha(text)).alias("__s"))
    out = out.join(new, (F.col("__o") == F.col("__ord")) & (F.col("__s") == F.col("__sha")), "left")
    return out.select(*[F.coalesce("__kept", F.col("doc")[c]).alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
