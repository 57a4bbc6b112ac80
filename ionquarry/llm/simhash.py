"""SimHash near-duplicates through anchor points of a covering code.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64
values of the document's word shingles, repeats included.  Documents whose
fingerprints differ in at most ``threshold`` (2) bits are linked.

The anchors are the codewords of two copies of the perfect [23, 12] Golay code,
laid over bits 0-22 and 23-45: 2^24 anchors.  Every 23-bit block lies within
the covering radius, 3, of exactly one codeword, so a fingerprint has one home
anchor.  It is replicated to every anchor within covering radius plus
threshold, the threshold being shared by the two blocks: about 61 anchors.  If
x and y differ in e1 and e2 bits of the blocks, e1 + e2 <= 2, then x's home is
within 3 + e1 and 3 + e2 of y, so y has a replica there and no link is lost.
At each anchor homes are compared with replicas by Hamming distance over all
64 bits, as an equi-join, which adaptive execution splits.  Where more than
``HOT`` fingerprints crowd one anchor (very many near copies of one text), they are
dealt to finer anchors instead, the trivial code of radius 0, and comparisons
stay in proportion to their number.

Work is done once for each distinct fingerprint; a fingerprint links to at most
2 080 others, whatever the size of a group of copies.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle of the whole sequence; a null
doc_id never becomes a component's id unless all ids in it are null; repeated
rows each give a row; other columns are ignored by ``classes`` and kept by
``near_dedup``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from ._common import release_shuffles, shuffle_parts, slices, trimmed, written
from ..operators.components import components
from ..operators.joins import joined_back

SEED = 42
#: Generator polynomial of the binary Golay code and its parameters (fixed values).
GOLAY, LENGTH, RADIUS = 0xAE3, 23, 3
THRESHOLD = 2
#: Fingerprints at an anchor beyond which they are dealt to finer anchors.
HOT = 20_000
LANES = np.uint64(0x0101010101010101)


def shingles(text: str | None, words: int = 3) -> np.ndarray:
    """Hashes of the word shingles of a whole text, repeats included: A-Z lower-cased, words split at ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(parts) <= words:
        return np.array([digest(join(parts), SEED)], dtype=np.uint64)
    grams = zip(*(parts[i:] for i in range(words)), strict=False)
    return np.fromiter((digest(join(g), SEED) for g in grams), dtype=np.uint64, count=len(parts) - words + 1)


def vote(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n = len(h)
    if n < 2:
        return int(h[0]) if n else 0
    starts = np.arange(0, n, 255)  # a lane of 8 bits holds sums of up to 255 bits
    out = 0
    for shift in range(8):
        lanes = np.add.reduceat((h >> np.uint64(shift)) & LANES, starts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in range(8):
            if 2 * int(counts[byte]) > n:
                out |= 1 << (8 * byte + shift)
    return out


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of a whole text."""
    return vote(shingles(text, words))


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, 1)):
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, fp long")


def _syndrome(block: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit block after division by the generator."""
    x = block.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        x = np.where((x >> bit) & 1, x ^ (GOLAY << (bit - 11)), x)
    return x


@cache
def _errors() -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """For each syndrome: the error of weight <= 3, and (error, weight over 3) up to weight 3 + threshold."""
    from itertools import combinations

    found: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    for weight in range(RADIUS + THRESHOLD + 1):
        pats = np.array([sum(1 << i for i in c) for c in combinations(range(LENGTH), weight)], dtype=np.int64)
        for e, s in zip(pats.tolist(), _syndrome(pats).tolist(), strict=True):
            found[s].append((e, max(0, weight - RADIUS)))
    return np.array([f[0][0] for f in found], dtype=np.int64), found


def anchors(fps: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home anchor of each fingerprint, and all anchors to replicate it to (home included)."""
    leader, near = _errors()
    mask = (1 << LENGTH) - 1
    a, b = (fps & np.uint64(mask)).astype(np.int64), ((fps >> np.uint64(LENGTH)) & np.uint64(mask)).astype(np.int64)
    sa, sb = _syndrome(a), _syndrome(b)
    code = lambda x: x >> 11  # noqa: E731  the 12 information bits of a codeword
    home = (code(a ^ leader[sa]) << 12) | code(b ^ leader[sb])
    every = []
    for x, y, s, t in zip(a.tolist(), b.tolist(), sa.tolist(), sb.tolist(), strict=True):
        left = [((x ^ e) >> 11 << 12, w) for e, w in near[s]]
        right = [((y ^ e) >> 11, w) for e, w in near[t]]
        every.append(np.array([p | q for p, v in left for q, w in right if v + w <= THRESHOLD], dtype=np.int32))
    return home.astype(np.int32), every


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints of ``nodes(fp)`` within the threshold; a pair may come more than once."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                fps = b.column(0).slice(at, 2000).to_numpy(zero_copy_only=False)
                home, every = anchors(fps.view(np.uint64))
                if len(fps):
                    counts = [len(e) for e in every]
                    anchor, fp = np.concatenate(every), np.repeat(fps, counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), pa.array(fp), pa.array(anchor == np.repeat(home, counts))],
                        names=["anchor", "fp", "home"],
                    )

    dealt = written(nodes.mapInArrow(trimmed(replicate), "anchor int, fp long, home boolean"), "anchors")
    crowded = written(dealt.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor"), "crowded")
    near = lambda p: p.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD)).select("a", "b")
    none = crowded.isEmpty()
    calm = dealt if none else dealt.join(crowded, "anchor", "left_anti")
    homes = calm.where("home").select("anchor", F.col("fp").alias("a"))
    pairs = near(homes.join(calm.select("anchor", F.col("fp").alias("b")), "anchor"))
    if none:
        return pairs
    # At a crowded anchor every word of 64 bits is an anchor (covering radius 0): two fingerprints within 2 bits
    # share a word within 1 bit of both, and no word has more than 65 of them.
    some = dealt.join(crowded, "anchor", "left_semi").select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    words = written(some.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("word")), "words")
    close = near(words.select("word", F.col("fp").alias("a")).join(words.select("word", F.col("fp").alias("b")), "word"))
    return pairs.union(close)


def _roots(prints: DataFrame) -> DataFrame:
    """(fp, root): each distinct fingerprint of ``prints`` with the smallest of its component."""
    spark = prints.sparkSession
    nodes = written(prints.select("fp").distinct(), "simhash-nodes")
    pairs = links(nodes.repartition(shuffle_parts(spark)))
    roots = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    release_shuffles(spark)
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): a row per row of ``docs``."""
    prints = written(fingerprints(docs, words, text, doc_id), "simhash")
    lows = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    labelled = lows.join(_roots(prints), "fp")
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined_back(labelled, lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id, nulls last.

    Two texts are linked if their fingerprints are within the threshold or their
    sets of shingles have a Jaccard similarity of 0.8 or more.
    """
    own = lambda t: shingles(t, words)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    frozen = written(docs.select(F.monotonically_increasing_id().alias("row"), whole), "near-rows")
    texts = frozen.select("row", F.col("doc")[text].alias("text"))
    prints = written(jaccard.sketches(texts, own, vote), "sketches")
    # The fingerprint's links, said of sets of shingles: each set with the first of its fingerprint's component.
    pairs = prints.select("fp", "node").distinct().join(_roots(prints), "fp").select("root", "node")
    stars = joined_back(pairs, pairs.groupBy("root").agg(F.min("node").alias("low")), "root").select(F.col("node").alias("u"), F.col("low").alias("v"))
    roots = jaccard.linked(prints, texts, written(stars.where("u <> v"), "simhash-edges"), own)
    idents = frozen.select("row", F.col("doc")[doc_id].cast("long").alias("id"))
    rows = written(joined_back(prints.select("row", "node"), roots, "node").join(idents, "row"), "near-labels")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "row"))["row"].alias("keep"))
    lost = joined_back(rows, best, "root").where("row <> keep").select("row")
    return frozen.join(lost, "row", "left_anti").select("doc.*")
