"""Exact top-k by integer inner product: dual-tree search over cover trees.

Vectors are quantised to integers.  The leaves of a cover tree over a sample of
at most ``SAMPLE`` vectors give anchors, a fine set for candidates and a coarse one
for queries; every vector goes to the cell of its nearest anchor, so a cell has a
centre and a covering radius.  A pair of cells can hold no better score than

    <q, c> + |q| * rc + |c| * rq + rq * rc

(q, c: centres, rq, rc: covering radii) and no worse one than that with minus
signs.  The cells that are sure to hold k candidates for every query of a cell
give it a floor, and pairs of cells that can't reach it are pruned before anything is
shuffled.  Cells of more than ``CANDIDATES`` or ``QUERIES`` rows are split by a hash,
and each pair of parts that is left is one group of bounded size.

In a group both sides become a cover tree again: a node has a centre, the
largest distance to it (covering radius) and children whose centres lie more than
half that radius apart and cover the node within it.  A pair of nodes
is pruned when its bound is less than the floor or the worst k-th score among the
queries below the query node.  Ties aren't pruned, as the smaller id wins.
Pairs of leaves are scored by one matrix product, in integers wherever doubles
would not be exact.

Each group returns at most k rows per query; a window with a group limit merges
them.  What is broadcast is as large as the anchors.

Defined cases: vectors that are null, or hold nulls or non-finite components,
and rows with a null id take no part; only vectors of the query's length are
candidates for it; repeated ids are rows of their own, and a query's own rows (equal
id) are never its candidates; query rows of one id with equal vectors count once,
with different vectors their candidates are ranked together under the id;
scores beyond 63 bits are cut to the largest long; fewer than k candidates are
all returned; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import trimmed, written

SCALE, K = 64, 20
#: Rows of a group's sides at most, cells of candidates at least and at most, vectors that the anchors are drawn from.
CANDIDATES, QUERIES, LEAST_CELLS, MOST_CELLS, SAMPLE = 32_768, 4_096, 24, 1_024, 4_096
LEAF = 128
#: A score that isn't there, and the bound under which sums of doubles are exact integers.
NONE, EXACT = np.iinfo(np.int64).min, 2.0**53


class Node:
    """``ids``: positions of the points below; ``kids``: [] for a leaf."""

    __slots__ = ("centre", "norm", "radius", "ids", "kids", "worst")

    def __init__(self, centre: np.ndarray, radius: float, ids: np.ndarray, kids: list):
        self.centre, self.norm, self.radius, self.ids, self.kids = centre, math.sqrt(float(centre @ centre)), radius, ids, kids
        self.worst = -math.inf

    def leaves(self) -> Iterator[Node]:
        for kid in self.kids:
            yield from kid.leaves()
        if not self.kids:
            yield self


def cover_tree(points: np.ndarray, ids: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Cover tree over ``points[ids]``; nodes of at most ``leaf`` points aren't divided."""
    ids = np.arange(len(points)) if ids is None else ids
    own = points[ids]
    centre = own[0]
    far = np.sqrt(((own - centre) ** 2).sum(axis=1))
    radius = float(far.max())
    if len(ids) <= leaf or radius == 0:
        return Node(centre, radius, ids, [])
    norms = (own * own).sum(axis=1)
    centres, dist, nearest = [0], far, np.zeros(len(ids), dtype=np.int64)
    # Farthest first: centres more than half the radius apart until all is covered.
    while len(centres) <= len(ids) // (leaf // 4) + 1 and dist.max() > radius / 2:
        new = int(dist.argmax())
        d = np.sqrt(np.maximum(norms + norms[new] - 2 * (own @ own[new]), 0))
        closer = d < dist
        dist, nearest = np.where(closer, d, dist), np.where(closer, len(centres), nearest)
        centres.append(new)
    kids = []
    for j, c in enumerate(centres):
        below = np.flatnonzero(nearest == j)
        if len(below):
            below = np.concatenate([[c], below[below != c]])
            kids.append(cover_tree(points, ids[below], leaf) if len(below) < len(ids) else Node(own[c], radius, ids[below], []))
    return Node(centre, radius, ids, kids)


def limits(product, q_norm, c_norm, q_radius, c_radius):
    """(least, most) that an inner product can be between balls around two centres."""
    reach = q_norm * c_radius + c_norm * q_radius + q_radius * c_radius
    slack = 1e-6 + 1e-9 * (q_norm + q_radius) * (c_norm + c_radius)
    return product - reach - slack, product + reach + slack


class Search:
    """Top k of each query over the candidates added so far; ties go to the smaller id.

    What scores under ``floor`` may be left out.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: float = -math.inf):
        self.q, self.q_ids, self.k, self.floor = queries, query_ids, k, floor
        self.scores = np.full((len(queries), k), NONE)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.root = cover_tree(queries.astype(np.float64))
        self.size = float(np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1).max()))

    def add(self, points: np.ndarray, ids: np.ndarray) -> None:
        dense = points.astype(np.float64)
        most = self.size * float(np.sqrt((dense**2).sum(axis=1).max()))
        # Integers of 64 bits, or of any size, where doubles would be rounded.
        kind = np.float64 if most < EXACT else np.int64 if most < 2.0**62 else object
        self.sides, self.p_ids = (self.q.astype(kind), points.astype(kind)), ids
        self._visit(self.root, cover_tree(dense))

    def _bound(self, a: Node, b: Node) -> float:
        return limits(float(a.centre @ b.centre), a.norm, b.norm, a.radius, b.radius)[1]

    def _visit(self, a: Node, b: Node) -> None:
        if self._bound(a, b) < max(a.worst, self.floor):
            return
        if not a.kids and not b.kids:
            self._score(a, b)
        elif b.kids and (not a.kids or b.radius >= a.radius):
            for kid in sorted(b.kids, key=lambda kid: -self._bound(a, kid)):
                self._visit(a, kid)
        else:
            for kid in a.kids:
                self._visit(kid, b)
            a.worst = min(kid.worst for kid in a.kids)

    def _score(self, a: Node, b: Node) -> None:
        s = self.sides[0][a.ids] @ self.sides[1][b.ids].T
        s = (np.clip(s, NONE + 1, np.iinfo(np.int64).max) if s.dtype == object else s).astype(np.int64)
        s[self.q_ids[a.ids][:, None] == self.p_ids[b.ids][None, :]] = NONE
        better = np.flatnonzero((s >= self.scores[a.ids, -1][:, None]).any(axis=1))
        if len(better):
            rows = a.ids[better]
            s = s[better]
            ids = np.broadcast_to(self.p_ids[b.ids], s.shape)
            s, ids = np.concatenate([self.scores[rows], s], axis=1), np.concatenate([self.found[rows], ids], axis=1)
            if s.shape[1] > 4 * self.k:  # all ties with the k-th score stay in
                kth = np.partition(~s, self.k - 1, axis=1)[:, self.k - 1 : self.k]
                wide = int((~s <= kth).sum(axis=1).max())
                if wide < s.shape[1]:
                    some = np.argpartition(~s, wide - 1, axis=1)[:, :wide]
                    s, ids = np.take_along_axis(s, some, 1), np.take_along_axis(ids, some, 1)
            order = np.lexsort((ids, ~s), axis=1)[:, : self.k]  # ~s falls as s rises, without overflow
            self.scores[rows], self.found[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)
        low = int(self.scores[a.ids, -1].min())
        a.worst = -math.inf if low == NONE else float(low)


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _usable(vector: Column) -> Column:
    x = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, x)


def anchors(sample: np.ndarray, cells: int) -> np.ndarray:
    """About ``cells`` centres: the leaves of a cover tree over the sample."""
    if cells <= 1 or not len(sample):
        return sample[:1]
    tree = cover_tree(sample, leaf=max(4, len(sample) // cells))
    return np.stack([leaf.centre for leaf in tree.leaves()][:MOST_CELLS])


def _dealt(rows: DataFrame, fine: dict[int, np.ndarray], coarse: dict[int, np.ndarray]) -> DataFrame:
    """``rows(id, v, asks)`` with the length of v and, for each set of anchors (by length), the nearest and its distance."""
    shared = rows.sparkSession.sparkContext.broadcast((fine, coarse))  # MOST_CELLS vectors at most, each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = np.diff(lists.offsets.to_numpy()).astype(np.int32)
            cells = [(np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)) for _ in range(2)]
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
                for (cell, far), sets in zip(cells, shared.value, strict=True):
                    # A length that the sample lacks has one cell, around zero.
                    centres = sets.get(d, np.zeros((1, d)))
                    cell[at] = np.argmax(x @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)
                    far[at] = np.sqrt(((x - centres[cell[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, b.column(2), pa.array(size), *(pa.array(c) for pair in cells for c in pair)], names=names)

    names = ["id", "v", "asks", "size", "cell", "far", "ask_cell", "ask_far"]
    return rows.select("id", "v", "asks").mapInArrow(trimmed(run), "id long, v array<long>, asks boolean, size int, cell int, far double, ask_cell int, ask_far double")


def _pruned(cells: list, asking: list, fine: dict, coarse: dict, k: int, own: int) -> tuple[list, list, dict]:
    """For each cell of queries its floor and the cells it has to look into, and the other way round.

    ``cells``, ``asking``: (size, cell, rows, radius).  ``own``: rows at most that a query can't count.
    """
    by_size, into, asked_by = defaultdict(list), [], defaultdict(list)
    for row in cells:
        by_size[row[0]].append(row)
    pairs = kept = 0
    for size, cell, n, radius in asking:
        there = by_size[size]
        centre = coarse.get(size, np.zeros((1, size)))[cell]
        others = fine.get(size, np.zeros((1, size)))[[c[1] for c in there]]
        low, high = limits(others @ centre, np.linalg.norm(centre), np.linalg.norm(others, axis=1), radius, np.array([c[3] for c in there]))
        order = np.argsort(-low)
        sure = np.cumsum(np.array([c[2] for c in there])[order]) >= k + own
        floor = float(low[order][np.argmax(sure)]) if sure.any() else -math.inf
        hit = [there[i] for i in np.flatnonzero(high >= floor)]
        pairs, kept = pairs + n * sum(c[2] for c in there), kept + n * sum(c[2] for c in hit)
        into.append((size, cell, -(-n // QUERIES), floor, [(c[1], -(-c[2] // CANDIDATES)) for c in hit]))
        for c in hit:
            asked_by[size, c[1]].append((cell, -(-n // QUERIES)))
    rows = {(c[0], c[1]): c[2] for c in cells}
    out = [(size, cell, -(-rows[size, cell] // CANDIDATES), found) for (size, cell), found in asked_by.items()]
    return into, out, {"pairs": pairs, "kept": kept}


def search(
    vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", report: dict | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score); ``queries``: the condition on ``vectors`` that chooses the queries.

    ``report`` is told how many pairs of a query and a candidate there are, and how many are kept by the cells' bounds.
    """
    spark, ident, body = vectors.sparkSession, F.col(f"`{vec_id}`"), F.col(f"`{embedding}`")
    usable = vectors.where(ident.isNotNull() & _usable(body))
    rows = written(usable.select(ident.cast("long").alias("id"), quantised(body, scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")), "vectors")
    n, m, wide = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1)), F.max(F.size("v"))).first()
    kinds = "query_id long, vec_id long, score long"
    if not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    some = rows.orderBy(F.xxhash64("id", F.lit(17))).limit(max(1, min(SAMPLE, (64 << 20) // (8 * max(1, wide))))).select("v").collect()
    drawn = defaultdict(list)
    for r in some:
        drawn[len(r.v)].append(r.v)
    sample = {d: np.array(v, dtype=np.float64) for d, v in drawn.items() if d}
    share = {d: len(v) / len(some) for d, v in sample.items()}
    fine = {d: anchors(v, min(MOST_CELLS, max(LEAST_CELLS, math.ceil(n / CANDIDATES * share[d])))) for d, v in sample.items()}
    coarse = {d: anchors(v, min(MOST_CELLS, math.ceil(m / QUERIES * share[d]))) for d, v in sample.items()}
    dealt = written(_dealt(rows, fine, coarse), "cells")
    asked = dealt.where("asks").dropDuplicates(["id", "v"])
    told = lambda f, cell, far: [tuple(r) for r in f.groupBy("size", cell).agg(F.count("*"), F.max(far)).collect()]  # noqa: E731  a row a cell
    own = dealt.groupBy("id").count().agg(F.max("count")).first()[0]
    into, by, found = _pruned(told(dealt, "cell", "far"), told(asked, "ask_cell", "ask_far"), fine, coarse, k, own)
    if report is not None:
        report.update(found)
    listed = "array<struct<cell:int,parts:int>>"
    plan_q = spark.createDataFrame(into, f"size int, ask_cell int, ask_parts int, floor double, there {listed}")
    plan_c = spark.createDataFrame(by, f"size int, cell int, parts int, there {listed}")
    spot = lambda seed, count: F.pmod(F.xxhash64("id", "v", F.lit(seed)), count).cast("int")

    def spread(side: DataFrame, cell: str, part: str) -> DataFrame:
        side = side.withColumn("to", F.explode("there")).withColumn(part, F.explode(F.sequence(F.lit(0), F.col("to.parts") - 1)))
        return side.withColumn(cell, F.col("to.cell")).drop("to", "there")

    keys, cols = ["size", "cell", "part", "ask_cell", "ask_part"], ["id", "v", "asks", "floor"]
    left = dealt.select("id", "v", "size", "cell").join(F.broadcast(plan_c), ["size", "cell"]).withColumn("part", spot(1, F.col("parts")))
    left = spread(left, "ask_cell", "ask_part").withColumns({"asks": F.lit(False), "floor": F.lit(0.0)})
    right = asked.select("id", "v", "size", "ask_cell").join(F.broadcast(plan_q), ["size", "ask_cell"]).withColumn("ask_part", spot(2, F.col("ask_parts")))
    right = spread(right, "cell", "part").withColumn("asks", F.lit(True))
    groups = left.select(*keys, *cols).unionByName(right.select(*keys, *cols)).groupBy(*keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, p = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(q) or not len(p):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        points, asks = (np.stack(x["v"].to_list()).astype(np.int64) for x in (p, q))
        found = Search(asks, q["id"].to_numpy(), k, float(q["floor"].iloc[0]))
        found.add(points, p["id"].to_numpy())
        at = np.nonzero(found.scores > NONE)
        return pd.DataFrame({"query_id": q["id"].to_numpy()[at[0]], "vec_id": found.found[at], "score": found.scores[at]})

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = groups.applyInPandas(run, kinds).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
