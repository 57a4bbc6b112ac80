"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, of its word pairs and of its
skip-grams (a word and the next but one), hashed to ``DIMENSIONS`` coordinates.
Each coordinate has its own learning rate, and the L1 term keeps weights at zero
until their gradients have summed to more than ``l1``, so the model is a short
list of weights that is broadcast to score every whole text.

The fit streams, pass after pass, over at most ``MOST_LABELLED`` labelled rows, of which at most
``MOST_POSITIVE`` are positive: the first ones by a hash of doc_id, so the
sample does not depend on how the rows lie.  It holds the coordinates and one batch of rows,
whatever the length of the texts.  The last fifth of the sample isn't
learnt from: the bias is shifted so that a score of 0.5 costs least there, an
error on a negative counting ``FALSE_ALARM`` times one on a positive.  Labels are all that is learnt from; doc_id only
chooses the folds, and lang and source are not read.

Defined cases: a null, empty or blank text scores the bias alone; labels other
than 0 and 1, null labels and labels without a document are left out; a doc_id
with several label rows counts once for each; with no labelled rows every score
is 0.5; other columns are ignored by ``score`` and kept by ``clean``; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WordIds, slices, trimmed, written

DIMENSIONS = 1 << 20
MOST_LABELLED, MOST_POSITIVE = 16_000, 6_000
EPOCHS = 3
FALSE_ALARM = 4.0
#: ASCII punctuation counts as white space.
_SPACED = bytes(c if not (32 < c < 127) or chr(c).isalnum() or chr(c) in "'" else 32 for c in range(256))
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Features:
    """Coordinates of a text, with repeats."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.ids, self.shift = WordIds(7), np.uint64(64 - (dimensions - 1).bit_length())

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()
        h = np.fromiter(map(self.ids.__getitem__, words), dtype=np.uint64, count=len(words))
        pairs = (h[:-1] * _PAIR + h[1:]) * _SKIP
        skips = (h[:-2] * _SKIP + h[2:]) * _PAIR
        return (np.concatenate([h, pairs, skips]) >> self.shift).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2, one example after the other."""

    def __init__(self, dimensions: int = DIMENSIONS, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dimensions), np.zeros(dimensions)
        self.bias_z = self.bias_n = 0.0

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        z, n = self.z[at], self.n[at]
        w, b = self._weights(z, n), self.bias
        g = 1 / (1 + np.exp(-np.clip(b + w.sum(), -35, 35))) - label
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g

    def dense(self) -> np.ndarray:
        return self._weights(self.z, self.n)

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.dense()
        at = np.flatnonzero(w)
        return at, w[at]


def threshold(sums: np.ndarray, labels: np.ndarray, false_alarm: float = FALSE_ALARM) -> float:
    """Where to cut the sums so that errors cost least; of equal cuts the middle of the widest gap.  0 if a class is missing."""
    if len(np.unique(labels)) < 2:
        return 0.0
    order = np.argsort(sums, kind="stable")
    s, y = sums[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(y)])  # positives below each cut
    alarms = np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    cost, gap = missed + false_alarm * alarms, np.diff(edges)
    best = np.lexsort((-gap, cost))[0]
    return float((edges[best] + edges[best + 1]) / 2)


@dataclass
class Model:
    bias: float
    at: np.ndarray
    weights: np.ndarray
    dimensions: int = DIMENSIONS


def fold(doc_id, folds: int):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id",
    most: int = MOST_LABELLED, most_positive: int = MOST_POSITIVE, epochs: int = EPOCHS, **settings: float,
) -> Model:
    """Learn from the rows of ``labels`` given here; hold rows out by leaving them out."""
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("k"), F.col(f"`{label}`").cast("int").alias("y"))
    known = known.where("k is not null and y in (0, 1)")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    positive = min(counts.get(1, 0), most_positive)
    share = {1: positive / max(1, counts.get(1, 0)), 0: min(1.0, (most - positive) / max(1, counts.get(0, 0)))}
    # The same hash decides for every copy of the table: the sample is bounded in the mean and cut at ``most``.
    spot = F.pmod(F.xxhash64(F.col("k"), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    # Scaled by the class's share, so that the classes lie mixed in the order of learning.
    spot = spot / F.when(F.col("y") == 1, share[1]).otherwise(share[0])
    known = known.withColumn("spot", spot).where("spot < 1")
    body = docs.select(F.col(f"`{doc_id}`").cast("long").alias("k"), F.col(f"`{text}`").alias("text"))
    # Bounded by ``most``, so the texts stay where they are.
    found = body.join(F.broadcast(known.limit(2 * most)), "k").select("k", "y", "spot", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in (s for batch in batches for s in slices(batch, 3)):
            sets = [np.unique(features.of(t)).astype("<u4").tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sets, pa.binary())], names=["k", "y", "spot", "at"])

    sets = found.mapInArrow(trimmed(extract), "k long, y int, spot double, at binary")
    sets = written(sets.orderBy("spot", "k", "y").limit(most), "labelled")
    n = sets.count()
    spared = n // 5

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come once for each pass, and once more, those that were spared, for the bias."""
        model, sums, truth, dense = Ftrl(**settings), [], [], None
        for b in batches:
            for turn, place, y, at in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                at = np.frombuffer(at, dtype="<u4").astype(np.int64)
                if turn < epochs:
                    model.learn(at, y)
                    continue
                if dense is None:
                    dense = model.dense()
                sums.append(model.bias + dense[at].sum())
                truth.append(y)
        at, w = model.sparse()
        bias = model.bias - threshold(np.array(sums), np.array(truth))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([bias, *w.tolist()])], names=["at", "w"])

    # One task learns: its rows are bounded by ``most``.
    order = Window.orderBy("spot", "k", "y", "at")  # of at most ``most`` rows
    placed = sets.withColumn("place", F.row_number().over(order)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(epochs))))
    placed = placed.where((F.col("turn") < epochs) == (F.col("place") <= n - spared)).select("turn", "place", "y", "at")
    sets = placed.repartition(1).sortWithinPartitions("turn", "place")
    learnt = sets.mapInArrow(trimmed(train), "at long, w double").toArrow().to_pandas()
    at, w = learnt["at"].to_numpy(), learnt["w"].to_numpy()
    first = at == -1
    return Model(float(w[first].sum()), at[~first], w[~first])


class Scorer:
    """The weighted sum of a text's features."""

    def __init__(self, model: Model):
        self.bias, self.features, self.dense = model.bias, Features(model.dimensions), np.zeros(model.dimensions)
        self.dense[model.at] = model.weights
        self.used = self.dense != 0

    def sums(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            at = self.features.of(t)
            out[i] = self.bias + self.dense[np.unique(at[self.used[at]])].sum()
        return out


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted): a row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most DIMENSIONS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in (s for batch in batches for s in slices(batch, 1)):
            scores = 1 / (1 + np.exp(-np.clip(scorer.sums(b.column(1).to_pylist()), -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(trimmed(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def clean(docs: DataFrame, model: Model, reject: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``reject`` or more; each row is judged where it lies."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, limit = Scorer(shared.value), np.log(reject / (1 - reject))
        for b in (s for batch in batches for s in slices(batch, at_column)):
            yield b.filter(pa.array(scorer.sums(b.column(at_column).to_pylist()) < limit))

    return docs.mapInArrow(trimmed(run), docs.schema)
