"""Language identification by the nearest of several centroids per language.

A text's vector counts its letter n-grams (1 to 3 bytes of the lower-cased text,
every run of other characters one space), hashed to ``DIMENSIONS``; counts are
damped (1 + ln), weighted by inverse document frequency and scaled to length 1.
Each language has ``CENTROIDS`` of them, from spherical k-means over its
training texts.  The language of the centroid with the largest cosine is
predicted; the score is that cosine (0 to 1).

Document frequencies are counted over all training texts.  The centroids are
fitted to at most ``MOST_PER_LANGUAGE`` texts of a language in the mean, those
with the smallest hash of doc_id, each language in a task of its own.

A text is ``rejected`` if it is farther from its centroid than the fitted texts
of that language are, ``BEYOND`` times the distance that all but ``OUTLIERS`` of
them keep, or if it has no letters and so no vector.  The name of the nearest language stays
beside that; only a text without letters is ``und``, and one beyond the
distance ``reject``, which can be lowered from its default, 1.

Defined cases: null and letterless texts give ``und`` and score 0; rows with a
null language are not learnt from; ties go to the smaller language name; other
columns are ignored; an empty table gives an empty table; without a training
row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, slices, trimmed, written

DIMENSIONS = 8192
CENTROIDS, ROUNDS = 4, 8
MOST_PER_LANGUAGE = 600
BEYOND, OUTLIERS = 1.1, 0.01
_LETTER = regex.compile(r"\p{L}")
_OTHER = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MIX = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def counts(text: str | None) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_OTHER).split()
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    two = raw[:-1] << np.uint32(8) | raw[1:]
    three = two[:-1] << np.uint32(8) | raw[2:]
    codes = np.concatenate([raw | np.uint32(1 << 24), two | np.uint32(2 << 24), three | np.uint32(3 << 24)])
    return np.bincount((codes * _MIX) >> np.uint32(19), minlength=DIMENSIONS)


def damped(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0.0).astype(np.float32)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reject: float = 1.0
    farthest: np.ndarray | None = None  # of each centroid's language, beyond which a text is rejected

    def vectors(self, texts: list[str]) -> np.ndarray:
        x = np.stack([damped(counts(t)) for t in texts]) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _spherical(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of unit vectors, started far from each other; no randomness."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(
    training: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id",
    centroids: int = CENTROIDS, most: int = MOST_PER_LANGUAGE, reject: float = 1.0,
) -> Model:
    """Learn from the rows given: their text and language."""
    rows = training.select(
        F.col(f"`{doc_id}`").cast("long").alias("k"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")
    ).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, min(1.0, most / n)).otherwise(share)
    spot = F.pmod(F.xxhash64(F.coalesce("k", F.lit(-1)), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("chosen", spot < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chosen rows' counts (dimension -1), then the task's document frequencies."""
        df, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for b in (s for batch in batches for s in slices(batch, 2)):
            kept = []
            for k, name, t, chosen in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if not has_letter(t):
                    continue
                c = counts(t)
                df += c > 0
                n += 1
                if chosen:
                    kept.append((-1, 0, k, name, damped(c).astype("<f2").tobytes()))
            if kept:
                yield _rows(kept)
        yield _rows([(d, int(f), None, None, None) for d, f in enumerate(df.tolist()) if f] + [(DIMENSIONS, n, None, None, None)])

    def _rows(kept: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), kinds, strict=True)], names=["d", "df", "k", "lang", "x"])

    made = written(rows.mapInArrow(trimmed(run), "d int, df long, k long, lang string, x binary"), "ngrams")
    df = np.zeros(DIMENSIONS + 1)
    for r in made.where("d >= 0").groupBy("d").agg(F.sum("df").alias("df")).collect():  # one row a dimension
        df[r["d"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1
    shared = training.sparkSession.sparkContext.broadcast(idf)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        """A language's centroids; its texts are bounded by ``most``."""
        own = sorted(zip(pdf["k"].fillna(-1), map(bytes, pdf["x"]), strict=True))
        x = np.stack([np.frombuffer(v, dtype="<f2").astype(np.float32) for _, v in own]) * shared.value
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _spherical(x, centroids)
        far = BEYOND * float(np.quantile(1 - np.clip((x @ c.T).max(axis=1), 0, 1), 1 - OUTLIERS))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "i": range(len(c)), "far": far, "c": [v.astype("<f4").tobytes() for v in c]})

    found = made.where("d = -1").select("lang", "k", "x").groupBy("lang").applyInPandas(cluster, "lang string, i int, far double, c binary")
    found = found.orderBy("lang", "i").collect()  # ``centroids`` rows a language
    discard(made)
    middles = np.stack([np.frombuffer(r["c"], dtype="<f4") for r in found]) if found else np.zeros((0, DIMENSIONS), np.float32)
    return Model([r["lang"] for r in found], middles, idf, reject, np.array([r["far"] for r in found]))


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, rejected): a row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages * CENTROIDS * DIMENSIONS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in (s for batch in batches for s in slices(batch, 1)):
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = part.column(1).to_pylist()
                names, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
                some = [i for i, t in enumerate(texts) if has_letter(t)] if m.languages else []
                if some:
                    cos = np.clip(m.vectors([texts[i] for i in some]) @ m.centroids.T, 0, 1)
                    best = np.argmax(cos, axis=1)
                    for i, j, c in zip(some, best.tolist(), cos[np.arange(len(some)), best].tolist(), strict=True):
                        if 1 - c <= m.reject:
                            names[i], scores[i], rejected[i] = m.languages[j], c, m.farthest is not None and 1 - c > m.farthest[j]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names), pa.array(scores), pa.array(rejected)],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, lang_pred string, score double, rejected boolean")
