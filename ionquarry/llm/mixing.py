"""Mixing sources to target weights by the cube method.

Every source has a weight and shares a budget of ``BUDGET`` times all sizes; a
source's target stops at ``MOST_TIMES`` its size and what it can't take is shared
again by weight among the others, until none is above.  A document of a source
with rate target / size is taken floor(rate) times for sure and once more with
the fractional rest as its inclusion probability.

Rows of one source with equal doc_id, size and text are one unit: of c such rows with
probability p each, floor(c * p) are taken once more and the rest of c * p is the
unit's probability.  So the flights see distinct units, however often a row is
repeated, and chunks chosen by a hash of doc_id, size and text stay small.

The probabilities are rounded by the flight of the cube method: of three
units with undecided probabilities, a direction in the null space of the
balancing constraints (the source's total size and its number of documents)
moves them, up or down with the odds that keep expectations, until one is 0 or 1
and the next unit takes its place.  Flights run in chunks of about ``CHUNK``
units of one source; each leaves at most
``LANDING`` units undecided, which fly on together in chunks of chunks until
one chunk is left.  Its last units are the landing: of all ways to decide
them, that which brings the source's total nearest to its target.  Chance comes from hashes, so
reruns agree.

Sources are numbered in a range-partitioned table and their targets found by sums
over it, so any number of them stays distributed.

Defined cases: null and blank texts have size 0 and are taken 0 words (but still
once or more as documents); a null source is a source, last in order; a source
without words has target 0; which of several equal rows is taken more often is left
open; other columns are ignored by ``plan`` and
kept by ``mix``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import numbered, shuffle_parts, written
from ..operators.joins import joined_back

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
BUDGET, MOST_TIMES = 1.5, 2.0
CHUNK = 4096
#: Documents that a chunk may leave undecided.
LANDING = 14
EPS = 1e-9


def sources(rows: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST_TIMES) -> DataFrame:
    """(name, source_size, n, target) of ``rows(source, size)``; ``n``: how many rows.

    A source is full if its share by weight is above ``most`` times its size; what
    the others share rises as sources become full, so the rounds end, each one
    sum over the table.
    """
    held = rows.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = [F.col("name").isNull().alias("__null"), F.encode("name", "UTF-8").alias("__bytes")]
    held = held.withColumns({"__null": order[0], "__bytes": order[1]}).repartitionByRange(shuffle_parts(rows.sparkSession), "__null", "__bytes")
    held = numbered(held.sortWithinPartitions("__null", "__bytes").drop("__null", "__bytes"), "ix")
    weight = F.element_at(F.lit(list(weights)).cast("array<double>"), (F.col("ix") % len(weights)).cast("int") + 1)
    held = held.withColumn("w", weight)
    total = held.agg(F.sum("source_size")).first()[0] or 0
    each = 0.0
    while True:
        full = F.lit(each) * F.col("w") > F.lit(most) * F.col("source_size")
        taken, left = held.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("w")))).first()
        if not left:
            break
        now = (budget * total - most * (taken or 0)) / left
        if now <= each:
            break
        each = now
    share = F.lit(each) * F.col("w")
    limit = F.lit(most) * F.col("source_size")
    return held.select("name", "source_size", "n", F.when(share > limit, limit).otherwise(share).cast("double").alias("target"))


def _chance(key: int, step: int) -> float:
    """Uniform in [0, 1), from a document's hash."""
    x = (key ^ (step * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def flight(units: Iterable[tuple[int, int, float]], level: int = 0) -> list[tuple[int, float]]:
    """(position, probability) for each (key, size, probability): all are 0 or 1 but two at most."""
    out: list[tuple[int, float]] = []
    held: list[list] = []  # [position, key, size, p], undecided
    for at, (key, size, p) in enumerate(units):
        if p < EPS or p > 1 - EPS:
            out.append((at, round(p)))
            continue
        held.append([at, key, size, p])
        if len(held) < 3:
            continue
        a, b, c = held
        u = (b[2] - c[2], c[2] - a[2], a[2] - b[2])  # null space of (sizes; ones)
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - h[3]) / v if v > 0 else h[3] / -v for h, v in zip(held, u, strict=True) if v)
        down = min(h[3] / v if v > 0 else (1 - h[3]) / -v for h, v in zip(held, u, strict=True) if v)
        move = up if _chance(c[1], level) * (up + down) < down else -down
        rest = []
        for h, v in zip(held, u, strict=True):
            h[3] += move * v
            if h[3] < EPS or h[3] > 1 - EPS:
                out.append((h[0], round(h[3])))
            else:
                rest.append(h)
        held = rest
    return sorted(out + [(h[0], h[3]) for h in held])


def landing(units: list[tuple[int, float]], owed: float) -> list[int]:
    """0 or 1 for each of the few (size, probability) left, so that their sizes come nearest to what is ``owed``."""
    sizes = np.array([s for s, _ in units], dtype=np.float64)
    picks = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    off = np.abs(picks @ sizes - owed)
    count = np.abs(picks.sum(axis=1) - sum(p for _, p in units))
    return picks[np.lexsort((count, np.round(off, 6)))[0]].tolist()


def _size(text):
    """Number of words of a text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


UNIT = ["source", "doc_id", "size", "body"]
SCHEMA = "source string, doc_id long, size long, body long, key long, p double"


def _fly(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc_id", "size", "body"], kind="stable").reset_index(drop=True)
        units = list(zip(pdf["key"].tolist(), pdf["size"].tolist(), pdf["p"].tolist(), strict=True))
        # What is left for the landing is of all sizes, so that its sums can come near to any total.
        ranked = sorted(range(len(units)), key=lambda i: (units[i][1], i))
        spared = {ranked[round(i * (len(units) - 1) / (LANDING - 3))] for i in range(LANDING - 2)}
        fly = [i for i in range(len(units)) if i not in spared]
        p = pdf["p"].tolist()
        for at, value in flight((units[i] for i in fly), level):
            p[fly[at]] = float(value)
        pdf["p"] = p
        return pdf[[c.split()[0] for c in SCHEMA.split(", ")]]

    return run


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    """Decide the at most ``LANDING`` units that a source has left; what they owe is their expected size."""
    pdf = pdf.sort_values(["key", "doc_id", "size", "body"], kind="stable").reset_index(drop=True)
    units = list(zip(pdf["size"].tolist(), pdf["p"].tolist(), strict=True))
    pdf["p"] = [float(x) for x in landing(units, sum(s * p for s, p in units))]
    return pdf[[c.split()[0] for c in SCHEMA.split(", ")]]


def _nulls(*names: str) -> list:
    """Columns without nulls, two for each name, by which rows can be joined plainly."""
    low = {"source": F.lit(""), "doc_id": F.lit(-(2**63))}
    return [c for n in names for c in ((F.coalesce(n, low[n]).alias(f"__{n}"), F.col(n).isNull().alias(f"__{n}_null")) if n in low else (F.col(n).alias(f"__{n}"),))]


_KEYS = ["__source", "__source_null", "__doc_id", "__doc_id_null", "__size", "__body"]


def plan(docs: DataFrame, weights: tuple = WEIGHTS, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(n, doc_id, source, size, source_size, target, times): a row per row; ``n`` tells rows apart."""
    ident, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{source}`").cast("string").alias("source"), ident.alias("doc_id"), _size(body).alias("size"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("body"))
    return _planned(written(rows.withColumn("n", F.monotonically_increasing_id()), "sizes"), weights).select("n", "doc_id", "source", "size", "source_size", "target", "times")


def _planned(rows: DataFrame, weights: tuple) -> DataFrame:
    """``rows(source, doc_id, size, body, n)``, written, with source_size, target, times."""
    by_source = written(sources(rows, weights), "sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    by_source = by_source.withColumns({"rate": rate, "chunks": F.ceil(F.col("n") / CHUNK).cast("int")})
    most = by_source.agg(F.max("chunks")).first()[0] or 1
    floor = F.floor("rate").cast("int")
    info = by_source.select(F.coalesce("name", F.lit("")).alias("__source"), F.col("name").isNull().alias("__source_null"), "source_size", "target", floor.alias("sure"), (F.col("rate") - floor).alias("part"), "chunks")

    units = rows.groupBy(*UNIT).agg(F.count("*").alias("c")).select("*", *_nulls("source"))
    # Plain shuffles on both sides: a hot source is split, few sources are broadcast.
    units = units.join(info.select("__source", "__source_null", "part", "chunks"), ["__source", "__source_null"])
    want = F.col("c") * F.col("part")
    more = F.floor(want + EPS).cast("long")
    p = F.greatest(want - more, F.lit(0.0))
    units = units.withColumns({"more": more, "p": F.when(p < EPS, 0.0).otherwise(p), "key": F.xxhash64("doc_id", "size", "body")})
    units = written(units.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(5)), F.col("chunks")).cast("int")).select(*UNIT, "c", "more", "p", "key", "chunk"), "units")

    undecided, level, decided = units.where("p > 0").select(*UNIT, "key", "p", "chunk"), 0, []
    while True:
        flown = written(undecided.groupBy("source", "chunk").applyInPandas(_fly(level), SCHEMA), "flight")
        decided.append(flown.where("p in (0, 1)"))
        rest = flown.where("p not in (0, 1)")
        if most == 1:
            break
        most, level = -(-most // (CHUNK // LANDING)), level + 1
        undecided = rest.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(most)).cast("int"))
    decided.append(rest.groupBy("source").applyInPandas(_land, SCHEMA))
    chosen = decided[0]
    for some in decided[1:]:
        chosen = chosen.unionByName(some)
    chosen = chosen.where("p = 1").select(*_nulls(*UNIT), F.lit(1).alias("once"))

    # What the rows of a unit take beyond the sure times: nearly all units are one row.
    told = units.select(*_nulls(*UNIT), "c", "more").join(chosen, _KEYS, "left").select(*_KEYS, "c", (F.col("more") + F.coalesce("once", F.lit(0))).alias("extra"))
    out = joined_back(rows.select("*", *_nulls(*UNIT)), told.where("extra > 0"), _KEYS, "left").join(info.select("__source", "__source_null", "source_size", "target", "sure"), ["__source", "__source_null"])
    out = out.withColumn("again", F.when(F.coalesce("extra", F.lit(0)) == 0, 0).when(F.col("extra") >= F.col("c"), 1))
    some = out.where("again is null")
    # Rows of a unit are numbered by parts of the table, so that a unit of any size is never one group.
    part = F.shiftright("n", 33).alias("__part")
    some = some.select("*", part).withColumn("__i", F.row_number().over(Window.partitionBy(*_KEYS, "__part").orderBy("n")))
    before = Window.partitionBy(*_KEYS).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = some.groupBy(*_KEYS, "__part").agg(F.count("*").alias("__c")).withColumn("__first", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    some = some.join(firsts, [*_KEYS, "__part"]).withColumn("again", (F.col("__first") + F.col("__i") <= F.col("extra")).cast("int"))
    names = ["n", "doc_id", "source", "size", "source_size", "target"]
    both = out.where("again is not null").select(*names, "sure", "again").unionByName(some.select(*names, "sure", "again"))
    return both.select(*names, (F.col("sure") + F.col("again")).alias("times"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix: every row as often as it is taken, with the columns of ``docs``."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.monotonically_increasing_id().alias("n"))
    whole = written(whole, "mix-rows")
    cell = lambda c: F.col("__row")[c]
    light = whole.select(cell(source).cast("string").alias("source"), cell(doc_id).cast("long").alias("doc_id"), _size(cell(text)).alias("size"), F.xxhash64(F.coalesce(cell(text), F.lit(""))).alias("body"), "n")
    times = _planned(written(light, "sizes"), weights).where("times > 0").select("n", "times")
    taken = whole.join(times, "n")
    return taken.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("__n")).select("__row.*")
