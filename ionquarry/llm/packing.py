"""Sequence packing: shortest pack first over the histogram of lengths.

Every document becomes its ids and an end id, cut into full sequences and a rest
shorter than ``SEQUENCE``.  Only the histogram of the rests (at most 2 047
counts) reaches the driver.  Lengths are placed longest first, each into the
pack with the most room (the shortest pack), by updating counts of packing
patterns rather than packs; the number of patterns is bounded by the number of
lengths, not of documents.  A document finds its place by its rank among those of equal length.

What room is left is filled by cutting: the shortest patterns' packs are taken
apart and their ids, laid end to end, fill the gaps of the others, so at most
one sequence in the whole result ends short of a gap of ``FILL`` ids or more.

Ranks need no shuffle: a task counts lengths as it writes its pieces to shared
storage, which freezes them, and a table of counts by task and length gives
each task's first ranks.  That table is as long as there are tasks times lengths, so it is
neither broadcast nor joined: it is written in files of ``GROUPED`` tasks each, and
whoever places a task's pieces reads that task's file.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed each for itself; ``doc_id`` may be null; other columns are ignored; an
empty table gives no pieces.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import open_fs, release_shuffles, scratch, shuffle_parts, slices, trimmed, written
from .tokens import TOKENIZER, encoder

SEQUENCE, END_ID = 2048, 1
#: Gaps from this many ids are filled by cutting.
FILL = 16
#: Tasks whose first ranks share a file.
GROUPED = 64


class Plan:
    """Where the rests go.  ``counts``: length -> documents.

    ``slots[length]``: rising first ranks, and for each what holds from there:
    (first sequence, packs, offset) or, for packs that were taken apart,
    (None, first place in the line of loose ids, 0).
    ``gaps``: the gaps that the line fills, as runs of equal gaps:
    (first place, first sequence, packs, offset, room).
    """

    def __init__(self, counts: dict[int, int], sequence: int = SEQUENCE, fill: int = FILL):
        self.sequence = sequence
        patterns = self._patterns(counts)
        self.slots: dict[int, tuple[list[int], list[tuple]]] = {}
        ranks: Counter = Counter()

        def place(length: int, n: int, where: tuple) -> None:
            firsts, places = self.slots.setdefault(length, ([], []))
            firsts.append(ranks[length])
            places.append(where)
            ranks[length] += n

        self.gaps, self.sequences, loose = [], 0, 0
        kept, apart = self._apart(patterns, fill)
        room = 0
        for lengths, n in kept:
            for offset, length in zip(accumulate((0, *lengths)), lengths, strict=False):
                place(length, n, (self.sequences, n, offset))
            gap = sequence - sum(lengths)
            if gap >= fill:
                self.gaps.append((room, self.sequences, n, sum(lengths), gap))
                room += gap * n
            self.sequences += n
        for lengths, n in apart:
            for length in lengths:
                place(length, n, (None, loose, 0))
                loose += length * n
        self.room, self.loose = room, loose
        self.starts = [g[0] for g in self.gaps]
        # What the gaps don't hold goes to sequences of its own.
        self.sequences += max(0, -(-(loose - room) // sequence))

    def _patterns(self, counts: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
        """Shortest pack first: [(lengths, packs)]."""
        open_: dict[int, list[list]] = {}  # total -> [[lengths, packs]]
        heap: list[int] = []
        for length in sorted(counts, reverse=True):
            left = counts[length]
            fits = self.sequence - length
            made: list[list] = []
            while left and heap and heap[0] <= fits:
                total = heap[0]
                patterns = open_[total]
                lengths, packs = patterns.pop()
                if not patterns:
                    heapq.heappop(heap)
                    del open_[total]
                many = min((self.sequence - total) // length, max(1, left // packs))
                used = min(packs, left // many)
                made.append([(*lengths, *(length,) * many), used])
                if packs > used:
                    made.append([lengths, packs - used])
                left -= used * many
            if left:
                many = self.sequence // length
                if left >= many:
                    made.append([(length,) * many, left // many])
                if left % many:
                    made.append([(length,) * (left % many), 1])
            for pattern in made:
                total = sum(pattern[0])
                if total not in open_:
                    open_[total] = []
                    heapq.heappush(heap, total)
                open_[total].append(pattern)
        return sorted((tuple(p), n) for group in open_.values() for p, n in group)

    def _apart(self, patterns: list, fill: int) -> tuple[list, list]:
        """Split the patterns into those kept and those taken apart, emptiest first, to fill the gaps of the kept."""
        line = sorted(patterns, key=lambda p: (sum(p[0]), p[0]))
        gap = lambda p: g if (g := self.sequence - sum(p)) >= fill else 0
        room, apart, loose = sum(gap(p) * n for p, n in line), [], 0
        kept = []
        for i, (lengths, n) in enumerate(line):
            size = sum(lengths)
            # Taking x packs apart adds x * size loose ids and takes away x gaps.
            x = max(0, min(n, (room - loose) // (size + gap(lengths))))
            if x:
                apart.append((lengths, x))
                loose, room = loose + x * size, room - x * gap(lengths)
            if x < n:
                kept = [(lengths, n - x), *line[i + 1 :]]
                break
        return kept, apart

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the rest, length, sequence, offset) of the rest with this rank; sequences count from 0."""
        firsts, places = self.slots[length]
        i = bisect_right(firsts, rank) - 1
        sequence, packs, offset = places[i]
        if sequence is not None:
            return [(0, length, sequence + (rank - firsts[i]) % packs, offset)]
        out, at, place = [], 0, packs + (rank - firsts[i]) * length
        while at < length:
            if place < self.room:
                start, seq, _, offset, gap = self.gaps[bisect_right(self.starts, place) - 1]
                seq, inside, most = seq + (place - start) // gap, (place - start) % gap, gap
            else:
                own = self.sequences - -(-(self.loose - self.room) // self.sequence)
                seq, inside = divmod(place - self.room, self.sequence)
                seq, offset, most = seq + own, 0, self.sequence
            n = min(length - at, most - inside)
            out.append((at, n, seq, offset + inside))
            at, place = at + n, place + n
        return out


def _cut(docs: DataFrame, tokenizer: str, end_id: int, sequence: int, text: str, doc_id: str) -> DataFrame:
    """A row per document: (part, doc_id, ids, width, n_ids, rest, rank, full_before), ranks and full sequences counted within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], dtype=code.dtype).tobytes()
        seen: Counter = Counter()
        full = 0
        for b in batches:
            for some in slices(b, 1):
                ids = [x + end for x in code.encode(some.column(1))]
                sizes = [len(x) // code.width for x in ids]
                ranks, before = [], []
                for n in sizes:
                    before.append(full)
                    full += n // sequence
                    ranks.append(seen[n % sequence])
                    seen[n % sequence] += 1
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part, np.int32)), some.column(0), pa.array(ids, pa.binary()), pa.array(np.full(k, code.width, np.int32)), pa.array(sizes, pa.int64()),
                     pa.array([n % sequence for n in sizes], pa.int32()), pa.array(ranks, pa.int64()), pa.array(before, pa.int64())],
                    names=["part", "doc_id", "ids", "width", "n_ids", "rest", "rank", "full_before"],
                )

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(trimmed(run), "part int, doc_id long, ids binary, width int, n_ids long, rest int, rank long, full_before long")


def pack(
    docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, sequence: int = SEQUENCE, fill: int = FILL,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): a row per piece; ``ids`` is a string of 32-bit integers."""
    spark = docs.sparkSession
    cut = written(_cut(docs, tokenizer, end_id, sequence, text, doc_id), "cut")
    release_shuffles(spark)
    by_part = cut.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("n_ids") / sequence)).alias("full"))
    by_part = written(by_part, "lengths")
    counts = {r["rest"]: r["n"] for r in by_part.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    all_full = by_part.agg(F.sum("full")).first()[0] or 0
    plan = spark.sparkContext.broadcast(Plan(counts, sequence, fill))  # as large as the histogram

    before = lambda *keys: Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_part.withColumn("first", F.coalesce(F.sum("n").over(before("rest")), F.lit(0)))
    ranks = ranks.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("rest", "first"))).alias("f"))
    fulls = by_part.groupBy("part").agg(F.sum("full").alias("full")).withColumn("slot", F.lit(0))
    fulls = fulls.select("part", F.coalesce(F.sum("full").over(before("slot")), F.lit(0)).alias("full_first"))  # a row a task
    parts = ranks.join(fulls, "part").select("part", F.col("f.rest").alias("rests"), F.col("f.first").alias("firsts"), "full_first", F.floor(F.col("part") / GROUPED).cast("int").alias("grouped"))
    folder = f"{scratch(spark, 'ranks')}/by-task"
    parts.repartition(shuffle_parts(spark), "grouped").write.partitionBy("grouped").parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held = plan.value, {}
        for b in (part for batch in batches for part in slices(batch, 2)):
            out = []
            for part, doc_id, ids, width, n, rest, rank, before in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if part not in held:
                    held = {part: _first_ranks(folder, part)}
                rests, firsts, full = held[part]
                rank, before = rank + int(firsts[np.searchsorted(rests, rest)]), before + full
                ids = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                whole = n // sequence
                got = [(k * sequence, sequence, before + k, 0) for k in range(whole)]
                if rest:
                    got += [(whole * sequence + s, m, all_full + q, o) for s, m, q, o in where.pieces(rest, rank)]
                out += [(doc_id, s, m, n, q, o, ids[s : s + m].tobytes()) for s, m, q, o in got]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], names=names)

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    columns = ["part", "doc_id", "ids", "width", "n_ids", "rest", "rank", "full_before"]
    return cut.select(*columns).mapInArrow(trimmed(run), ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))


def _first_ranks(folder: str, part: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A task's lengths in order, the first rank of each, and the full sequences before it."""
    import pyarrow.dataset as ds

    fs, path = open_fs(f"{folder}/grouped={part // GROUPED}")
    row = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["rests", "firsts", "full_first"], filter=ds.field("part") == part)
    return np.array(row["rests"][0].as_py()), np.array(row["firsts"][0].as_py()), row["full_first"][0].as_py()
