"""Peak matching within a tolerance: as a join of tables, and greedily one to one within a pair of spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PEAKS
from .joins import joined_back


def tolerance_join(left: DataFrame, right: DataFrame, tol: float, on: str = "mz", keys: list[str] | None = None) -> DataFrame:
    """Rows of both sides with equal ``keys`` whose ``on`` differ by at most ``tol``; the right side's is ``<on>_r``.

    An equi-join on buckets of width ``tol``: the left side goes to its own
    bucket and both neighbours, so no pair is lost and none is found twice.
    """
    keys = keys or []
    b = F.floor(F.col(on) / tol).cast("long")
    spread = left.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    names = {c: f"{c}_r" for c in right.columns if c not in keys}
    other = right.withColumn("_b", b).withColumnsRenamed(names)
    return spread.join(other, [*keys, "_b"]).where(F.abs(F.col(on) - F.col(f"{on}_r")) <= tol).drop("_b")


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from 0, as SQL rounds; ``np.round`` takes them to the even digit, and products of roots do lie on halves."""
    y = np.abs(x) * 10.0**digits
    whole = np.floor(y)
    return np.copysign((whole + (y - whole >= 0.5)) / 10.0**digits, x)


def greedy_cosine(a: list, b: list, tol: float, mz_power: float, intensity_power: float) -> tuple[float, int]:
    """(score, matches) of two (mz, intensity) arrays: best products first, each peak used once.

    Equal products are taken in order of the first, then the second spectrum's peaks.
    """
    (m, x), (n, y) = a, b
    if not len(m) or not len(n):
        return 0.0, 0
    wx, wy = m**mz_power * x**intensity_power, n**mz_power * y**intensity_power
    size = np.sqrt((wx * wx).sum() * (wy * wy).sum())
    i, j = np.nonzero(np.abs(m[:, None] - n[None, :]) <= tol)
    if size <= 0 or not len(i):
        return 0.0, 0
    product = wx[i] * wy[j]
    score, count, used_i, used_j = 0.0, 0, set(), set()
    for k in np.lexsort((j, i, -rounded(product, 12))):
        if i[k] not in used_i and j[k] not in used_j:
            used_i.add(i[k])
            used_j.add(j[k])
            score += product[k]
            count += 1
    return float(score / size), count


def _arrays(peaks: Column) -> list[Column]:
    """m/z and intensity of peaks as two flat arrays."""
    own = F.coalesce(peaks, F.array().cast(PEAKS))
    return [own["mz"], own["intensity"]]


def cosine_greedy(a: Column, b: Column, tol: float = 0.1, mz_power: float = 0.0, intensity_power: float = 1.0) -> Column:
    """STRUCT<score, matches> of two peak arrays, in Arrow batches of flat arrays."""

    @F.pandas_udf("score double, matches int")
    def run(m: pd.Series, x: pd.Series, n: pd.Series, y: pd.Series) -> pd.DataFrame:
        found = [greedy_cosine((p, q), (r, s), tol, mz_power, intensity_power) for p, q, r, s in zip(m, x, n, y, strict=True)]
        return pd.DataFrame(found, columns=["score", "matches"])

    return run(*_arrays(a), *_arrays(b))


#: Scorers of two peak arrays by name; register more as functions of (a, b, tol, mz_power, intensity_power).
SCORERS = {"cosine_greedy": lambda a, b, **kw: cosine_greedy(a, b, **kw)["score"]}
#: Spectra of a sub-block, and peaks that are looked up at once.
SUB_BLOCK, AT_ONCE = 512, 1_000_000
#: Digits to which scores are rounded before they are compared with a threshold, so that the order of a sum doesn't decide.
DIGITS = 6


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of ``count`` consecutive places from ``first`` for each owner."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count - first, count)


def _greedy(pair: np.ndarray, i: np.ndarray, j: np.ndarray, product: np.ndarray, n: int) -> np.ndarray:
    """Each pair's sum of greedily chosen products.

    In the order of choice, a match that is the first of both of its peaks is
    chosen whatever comes before; those are taken, what they exclude goes, and so on.
    """
    product = rounded(product, 12)
    order = np.lexsort((j, i, -product, pair))
    pair, i, j, product = pair[order], i[order], j[order], product[order]
    total = np.zeros(n)
    width = int(max(i.max(), j.max())) + 1 if len(i) else 1
    while len(pair):
        left, right = pair * width + i, pair * width + j
        sides = []
        for key in (left, right):
            lead = np.zeros(len(key), dtype=bool)
            lead[np.unique(key, return_index=True)[1]] = True
            sides.append(lead)
        take = sides[0] & sides[1]
        np.add.at(total, pair[take], product[take])
        rest = ~(np.isin(left, left[take]) | np.isin(right, right[take]))
        pair, i, j, product = pair[rest], i[rest], j[rest], product[rest]
    return total


def block_scores(group: np.ndarray, sub: np.ndarray, cross: np.ndarray, sizes: np.ndarray, mz: np.ndarray, x: np.ndarray, tol: float, mz_power: float, intensity_power: float):
    """(first row, second row, greedy cosine) of pairs of rows in one ``group`` (rows lie by group), a slice at a time.

    Where ``cross``, only rows of different ``sub`` are paired.  Peaks lie by row, in order of m/z.
    """
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    w = mz**mz_power * x**intensity_power
    power = np.bincount(row, w * w, len(sizes))
    gap = float(mz.max() - mz.min() + 4 * tol + 4) if len(mz) else 1.0
    low = float(mz.min()) if len(mz) else 0.0
    keys = row * gap + (mz - low)  # rises through all peaks
    slack = tol + 1e-6 + gap * len(sizes) * 1e-15
    ends = np.searchsorted(group, group, side="right")
    partners = ends - np.arange(len(group)) - 1
    work, at = np.concatenate([[0], np.cumsum(partners * np.maximum(sizes, 1))]), 0
    while at < len(group):
        end = max(at + 1, int(np.searchsorted(work, work[at] + AT_ONCE, side="right")) - 1)
        u, v = _spread(np.arange(at, end) + 1, partners[at:end])
        u = u + at
        keep = ~cross[u] | (sub[u] != sub[v])
        u, v = u[keep], v[keep]
        pair, i = _spread(cuts[u], sizes[u])
        base = v[pair] * gap + (mz[i] - low)
        lo = np.maximum(np.searchsorted(keys, base - slack, side="left"), cuts[v[pair]])
        hi = np.minimum(np.searchsorted(keys, base + slack, side="right"), cuts[v[pair] + 1])
        found, j = _spread(lo, np.maximum(hi - lo, 0))
        i, pair = i[found], pair[found]
        near = np.abs(mz[i] - mz[j]) <= tol
        pair, i, j = pair[near], i[near], j[near]
        total = _greedy(pair, i - cuts[u[pair]], j - cuts[v[pair]], w[i] * w[j], len(u))
        size = np.sqrt(power[u] * power[v])
        yield u, v, np.where(size > 0, total / np.where(size > 0, size, 1), 0.0)
        at = end


def _block_pairs(own: DataFrame, tol: float, mz_power: float, intensity_power: float, least: float | None) -> DataFrame:
    """(k, a, b, score) of ``own(k, a, p)``: blocks are dealt to pairs of sub-blocks, a group of bounded size each."""
    kind, parts = own.schema["a"].dataType.simpleString(), int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = own.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    rows = joined_back(own, sizes, "k").withColumn("m", F.ceil(F.col("n") / SUB_BLOCK).cast("int"))
    mz, x = _arrays(F.array_sort("p"))
    rows = rows.select("k", "a", mz.alias("mz"), x.alias("x"), F.pmod(F.xxhash64("a"), "m").cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("t"))
    rows = rows.withColumns({"i": F.least("s", "t"), "j": F.greatest("s", "t")})
    rows = rows.repartition(parts, "k", "i", "j").sortWithinPartitions("k", "i", "j", "a").select("k", "i", "j", "s", "a", "mz", "x")

    def score(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        t = t.combine_chunks()
        k, i, j, sub = np.array(t["k"].to_pylist()), *(t[c].to_numpy() for c in ("i", "j", "s"))
        new = np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        lists = t["mz"].chunk(0)
        flat = [t[c].chunk(0).flatten().to_numpy(zero_copy_only=False) for c in ("mz", "x")]
        for u, v, s in block_scores(np.cumsum(new), sub, i != j, np.diff(lists.offsets.to_numpy()), *flat, tol, mz_power, intensity_power):
            some = np.flatnonzero(rounded(s, DIGITS) >= least) if least is not None else np.arange(len(s))
            a, b = t["a"].take(pa.array(u[some])), t["a"].take(pa.array(v[some]))
            out = pa.table([t["k"].take(pa.array(u[some])), a, b, pa.array(s[some])], names=["k", "a", "b", "score"])
            yield from out.filter(pc.not_equal(a, b)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        open_ = None  # the group of what is held
        for batch in batches:
            if not batch.num_rows:
                continue
            place = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            last = place.index(place[-1])  # what is before belongs to whole groups
            if held and last == 0 and place[0] == open_:
                held.append(batch)
                continue
            if whole := [*held, batch.slice(0, last)]:
                yield from score(pa.Table.from_batches(whole))
            held, open_ = [batch.slice(last)], place[-1]
        if held:
            yield from score(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"k string, a {kind}, b {kind}, score double")


def pair_scores(
    spectra: DataFrame, keys: list[str], pos: str = "pos", scorer: str = "cosine_greedy", tol: float = 0.1, mz_power: float = 0.0, intensity_power: float = 1.0,
    least: float | None = None,
) -> DataFrame:
    """(keys, a, b, score) of each pair of spectra with equal keys (nulls equal), a < b by position; with ``least``, of those that score as much when rounded to ``DIGITS``."""
    own = spectra.select(F.struct(*keys).alias("k") if keys else F.lit("").alias("k"), F.col(pos).alias("a"), F.col("peaks").alias("p"))
    own = own.withColumn("k", F.coalesce(F.to_json("k", {"ignoreNullFields": "false"}), F.lit(""))) if keys else own
    if scorer == "cosine_greedy":
        return _block_pairs(own, tol, mz_power, intensity_power, least)
    other = own.select("k", F.col("a").alias("b"), F.col("p").alias("q"))
    score = SCORERS[scorer](F.col("p"), F.col("q"), tol=tol, mz_power=mz_power, intensity_power=intensity_power)
    found = own.join(other, "k").where("a < b").select("k", "a", "b", score.alias("score"))
    return found if least is None else found.where(F.round("score", DIGITS) >= least)
