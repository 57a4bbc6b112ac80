"""Pairs of texts whose sets of word shingles have a Jaccard similarity of ``SIMILAR`` or more.

Each distinct set of shingles is a node.  It has ``BANDS`` keys of ``ROWS_A_BAND``
minwise hashes; two sets that share a key are candidates.  Four bits of every hash
are kept as a mark, and candidates with more than ``UNLIKE`` unequal marks are dropped without a
look at their texts; all others are compared exactly, by their texts.  A pair at 0.8
shares no key with probability (1 - 0.8^5)^32 = 3e-6 and has 30 unequal marks in the mean, more
than ``UNLIKE`` with probability 6e-5; a pair at 0.6 has 60.

So that a large group of near copies isn't compared pair by pair, candidates are
first compared with the smallest node of their bucket and, where much is left,
with ``GUIDES`` others.  After that only pairs in different components are left; of
these, at least one isn't in the component of the bucket's smallest node.  All of them
are compared: most by their texts, those of buckets with more than ``MANY`` such pairs
(large groups of texts a little less similar) in blocks of bounded size, which count what
sets share by postings and hand on only pairs that are similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slices, trimmed, written
from ..operators.components import components
from ..operators.joins import joined_back
from ..operators.topk import Sparse, _sums

#: The least similarity, as a fraction.
SIMILAR = 4, 5
BANDS, ROWS_A_BAND = 32, 5
#: Nodes of a bucket that all others are compared with, pairs of a bucket that are many, and rows of a block.
GUIDES, MANY, BLOCK = 8, 20_000, 512
#: Unequal marks that a candidate may have, and marks of a long.
UNLIKE, IN_A_LONG = 50, 16
LONGS = BANDS * ROWS_A_BAND // IN_A_LONG
#: Shingles of sets that a worker remembers.
HELD = 2_000_000
#: Sets below this size are similar enough only if they are equal.
LEAST = 4
_RNG = np.random.default_rng(2026)
FLIPS = _RNG.integers(0, 1 << 32, BANDS * ROWS_A_BAND, dtype=np.uint32)
FACTORS = _RNG.integers(0, 1 << 32, BANDS * ROWS_A_BAND, dtype=np.uint32) | np.uint32(1)
MIX = np.uint64(0xD6E8FEB86659FD93)


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, marks) of non-empty sets of hashes, a row for each set: a key a band, ``IN_A_LONG`` marks a number."""
    flat, low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), np.empty((BANDS * ROWS_A_BAND, len(sets)), dtype=np.uint32)
    starts, mixed = np.cumsum([0, *[len(s) for s in sets[:-1]]]), np.empty_like(flat)
    for i in range(BANDS * ROWS_A_BAND):
        np.bitwise_xor(flat, FLIPS[i], out=mixed)
        np.multiply(mixed, FACTORS[i], out=mixed)
        np.minimum.reduceat(mixed, starts, out=low[i])
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(sets), axis=1)
    for i in range(ROWS_A_BAND):
        keys = (keys ^ low[i::ROWS_A_BAND]) * MIX
        keys ^= keys >> np.uint64(32)
    marks = np.zeros((LONGS, len(sets)), dtype=np.uint64)
    for i in range(IN_A_LONG):
        marks |= (low[i::IN_A_LONG] & np.uint32(15)).astype(np.uint64) << np.uint64(4 * i)
    return keys.T, marks.T


def alike(a: Column, b: Column) -> Column:
    """Whether two nodes' marks differ in ``UNLIKE`` places at most."""
    unequal = F.lit(0)
    for i in range(LONGS):
        x = a[i].bitwiseXOR(b[i])
        some = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        unequal = unequal + F.bit_count(some.bitwiseAND(0x1111111111111111))
    return unequal <= UNLIKE


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays without repeats, are similar enough."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[0] * (len(a) + len(b) - both) <= SIMILAR[1] * both


def sketches(rows: DataFrame, shingles, vote) -> DataFrame:
    """(row, fp, node, n, keys, marks) of ``rows(row, text)``: fingerprint, set of shingles, its size, its keys and their marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, 1, 1 << 20)):
            every = [shingles(t) for t in b.column(1).to_pylist()]
            fps = np.array([vote(h) for h in every], dtype=np.uint64).view(np.int64)
            sets = [np.unique(h) for h in every]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            large = np.flatnonzero(sizes >= LEAST)
            keys, marks = sketch([sets[i] for i in large]) if len(large) else (np.empty((0, n), np.uint64) for n in (BANDS, LONGS))
            listed = lambda x, n: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(sizes >= LEAST, n, 0))]).astype(np.int32), x)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fps), pa.array(nodes), pa.array(sizes), listed(keys.ravel().view(np.int64), BANDS), listed(marks.ravel().view(np.int64), LONGS)],
                names=["row", "fp", "node", "n", "keys", "marks"],
            )

    return rows.select("row", "text").mapInArrow(trimmed(run), "row long, fp long, node long, n long, keys array<long>, marks array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingles) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough; ``nodes(node, row)``, ``rows(row, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def own(node: int, text: str) -> np.ndarray:
            nonlocal size
            if node not in held:
                if size > HELD:
                    held.clear()
                    size = 0
                held[node] = np.unique(shingles(text))
                size += len(held[node])
            return held[node]

        for b in (s for batch in batches for s in slices(batch, 2)):
            good = [similar(own(x, one), own(y, other)) for x, y, one, other in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    need = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = written(nodes.select("node", "row").join(need, "node").join(rows, "row").select("node", "text"), "pair-texts")
    side = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(trimmed(run), "a long, b long"), "similar")


def _sized(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").withColumn(
        "root", F.coalesce("root", "node")
    ).drop("__node")


def _sets(need: DataFrame, nodes: DataFrame, rows: DataFrame, shingles) -> DataFrame:
    """(node, bits): the sorted hashes of the sets of the nodes in ``need(node)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, 1, 1 << 20)):
            sets = [np.unique(shingles(t)).view(np.int64) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int64), *sets]))], names=["node", "bits"])

    texts = nodes.select("node", "row").join(need, "node").join(rows, "row").select("node", "text")
    return written(texts.mapInArrow(trimmed(run), "node long, bits array<long>"), "sets")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of similar pairs of (key, so, s, odd, node, root, bits) that lie by group: an odd row with another."""
    held: list[pa.RecordBatch] = []

    def close() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        odd, node, root = t["odd"].to_numpy(), t["node"].to_numpy(), t["root"].to_numpy()
        lists = t["bits"].chunk(0)
        cuts, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(zero_copy_only=False)

        def side(at: np.ndarray) -> Sparse:
            bits = np.concatenate([np.empty(0, np.int64), *(flat[cuts[i] : cuts[i + 1]] for i in at)])
            return Sparse(node[at].tolist(), bits, np.ones(len(bits)), np.diff(cuts)[at])

        x, y = np.flatnonzero(odd), np.flatnonzero(~odd)
        if len(x) and len(y):
            a, b = side(x), side(y)
            for at, both, _ in _sums(a, b):
                n = a.l1[at : at + len(both), None] + b.l1
                i, j = np.nonzero((SIMILAR[0] * (n - both) <= SIMILAR[1] * both) & (root[x][at : at + len(both), None] != root[y]))
                one, two = a.ids[at + i], b.ids[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    for batch in batches:
        place = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi > lo:
                if held and [held[-1].column(c)[0].as_py() for c in range(3)] != place[lo].tolist():
                    yield from close()
                    held.clear()
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield from close()


def _blocks(found: DataFrame, sizes: DataFrame, nodes: DataFrame, rows: DataFrame, shingles) -> DataFrame:
    """The similar pairs in ``found(key, node, root, odd)``, an odd node with any other of its bucket; ``sizes(key, all, odd)``."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = joined_back(found.select("key", "node", "root", "odd"), sizes.select("key", count("all").alias("m"), count("odd").alias("mo")), "key")
    spot = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = own.where("odd").select("key", spot(1, "mo").alias("so"), every("m").alias("s"), "odd", "node", "root")
    others = own.select("key", every("mo").alias("so"), spot(2, "m").alias("s"), F.lit(False).alias("odd"), "node", "root")
    sets = _sets(found.select("node").distinct(), nodes, rows, shingles)
    dealt = asks.unionByName(others).join(sets, "node").select("key", "so", "s", "odd", "node", "root", "bits")
    dealt = dealt.repartition(parts, "key", "so", "s").sortWithinPartitions("key", "so", "s")
    return written(dealt.mapInArrow(trimmed(_shared), "a long, b long"), "block-pairs")


def linked(sketched: DataFrame, rows: DataFrame, edges: DataFrame, shingles, many: int = MANY) -> DataFrame:
    """(node, root) of every node, by the ``edges(u, v)`` given and all similar pairs."""
    nodes = written(sketched.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("marks").alias("marks")), "nodes")
    dealt = written(nodes.select("node", "n", F.explode("keys").alias("key")), "bands")
    first = dealt.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lo"), F.max("node").alias("hi")).where("lo.node < hi")
    first = first.select("key", F.col("lo.node").alias("lo"), F.col("lo.n").alias("lo_n"))
    member = written(joined_back(dealt, first, "key"), "members")
    stars = member.where((F.col("node") != F.col("lo")) & _sized(F.col("n"), F.col("lo_n"))).select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    marked = lambda end: nodes.select(F.col("node").alias(end), F.col("marks").alias(f"m{end}"))
    stars = stars.join(marked("a"), "a").join(marked("b"), "b").where(alike(F.col("ma"), F.col("mb"))).select("a", "b")
    as_edges = lambda p: p.select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(edges.select("u", "v").union(as_edges(_verified(stars, nodes, rows, shingles))))

    def joint(roots: DataFrame, found: DataFrame) -> DataFrame:
        return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(as_edges(found)))

    def unsettled(found: DataFrame) -> DataFrame:
        """``found(key, node, n, root)`` of buckets with several components, with marks, and ``odd``: not of the smallest node's component."""
        mixed = found.groupBy("key").agg(F.min(F.struct("node", "root"))["root"].alias("main"), F.min("root").alias("r"), F.max("root").alias("s"))
        mixed = mixed.where("r < s").select("key", "main")
        found = joined_back(found, mixed, "key").select("key", "node", "n", "root", (F.col("root") != F.col("main")).alias("odd"))
        return found.join(nodes.select("node", "marks"), "node")

    def left(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The unsettled rows, and the number of all and of odd rows of each bucket."""
        rest = written(unsettled(_rooted(member.select("key", "node", "n"), roots)), "unsettled")
        sizes = rest.groupBy("key").agg(F.count("*").alias("all"), F.count(F.when(F.col("odd"), 1)).alias("odd"))
        return rest, written(sizes, "unsettled-sizes")

    def pairs(found: DataFrame) -> DataFrame:
        odd = found.where("odd").select("key", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("root").alias("xr"), F.col("marks").alias("xm"))
        able = (F.col("xr") != F.col("root")) & (~F.col("odd") | (F.col("x") < F.col("node"))) & _sized(F.col("xn"), F.col("n")) & alike(F.col("xm"), F.col("marks"))
        return odd.join(found, [odd["key"] == found["key"], able]).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()

    rest, sizes = left(roots)
    if not sizes.where(F.col("all") * F.col("odd") > many).isEmpty():
        own = F.struct("node", "n", "root", "marks")
        some = rest.groupBy("key").agg(F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), own.alias("o")))["o"] for i in range(GUIDES)]).alias("guides"))
        able = lambda g: (g["root"] != F.col("root")) & _sized(F.col("n"), g["n"]) & alike(F.col("marks"), g["marks"])
        led = joined_back(rest, some, "key").select("node", F.explode(F.transform(F.filter("guides", able), lambda g: g["node"])).alias("g"))
        found = _verified(led.select(F.least("node", "g").alias("a"), F.greatest("node", "g").alias("b")).distinct(), nodes, rows, shingles)
        if not found.isEmpty():
            roots = joint(roots, found)
            rest, sizes = left(roots)
    crowded = sizes.where(F.col("all") * F.col("odd") > many)
    if crowded.isEmpty():
        last = _verified(pairs(rest), nodes, rows, shingles)
    else:
        calm = rest.join(crowded.select("key"), "key", "left_anti")
        last = _verified(pairs(calm), nodes, rows, shingles).union(_blocks(rest.join(crowded.select("key"), "key", "left_semi"), crowded, nodes, rows, shingles))
    return _rooted(nodes.select("node"), roots if last.isEmpty() else joint(roots, last))
