"""Merging of near-identical spectra into consensus spectra.

Blocks are compounds split by ion mode and charge.  Within a block, spectra whose
greedy cosine reaches the threshold are linked, and each connected component
(single linkage) becomes one spectrum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import inchikey14, present
from ..functions.vectors import sum_normalized
from ..schema import COMBINED, FROM_FIRST, PEAKS
from ..settings import MergeSettings
from .aggregate import median_or_first, vote
from .components import components
from .peaks import pair_scores

#: How many bins stay when none is in enough spectra (fixed value).
FALLBACK = 50
BLOCK = ["comp_id", "_mode", "charge"]


def blocked(spectra: DataFrame, merge_unannotated: bool = False) -> DataFrame:
    """Spectra with ``comp_id`` and ``_mode``; without a key they are left out, or share one group."""
    keyed = spectra if "comp_id" in spectra.columns else spectra.withColumn("comp_id", inchikey14(F.col("inchikey")))
    keyed = keyed.withColumn("_mode", F.lower(F.coalesce("ionmode", F.lit("unknown"))))
    return keyed.withColumn("comp_id", F.coalesce("comp_id", F.lit(""))) if merge_unannotated else keyed.where(present(F.col("comp_id")))


def clusters(spectra: DataFrame, settings: MergeSettings = MergeSettings(), pos: str = "pos") -> DataFrame:
    """``spectra`` (blocked) with ``cluster_id``, the smallest position of the cluster."""
    scores = pair_scores(spectra, BLOCK, pos, settings.scorer, tol=settings.fragment_tol, mz_power=settings.mz_power, intensity_power=settings.intensity_power, least=settings.cosine_threshold)
    edges = scores.select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(edges)
    return spectra.join(roots, spectra[pos] == roots["node"], "left").withColumn("cluster_id", F.coalesce("root", pos)).drop("node", "root")


def consensus_peaks(mz: np.ndarray, intensity: np.ndarray, spectrum: np.ndarray, n: int, tol: float, min_frac: float) -> tuple[np.ndarray, np.ndarray]:
    """Bins of pooled, sum-normalised peaks, left to right around a running weighted centre.

    A bin stays if it has peaks of at least ``min_frac`` of the n spectra; if none
    does, the ``FALLBACK`` strongest stay.  In order of m/z, intensities sum to 1.
    A bin without intensity has the plain mean of its m/z.
    """
    order = np.lexsort((spectrum, mz))
    mz, intensity, spectrum = mz[order], intensity[order], spectrum[order]
    start, centre, weight = np.zeros(len(mz), dtype=bool), np.inf, 0.0
    for i, (m, w) in enumerate(zip(mz.tolist(), intensity.tolist(), strict=True)):
        if abs(m - centre) <= tol:
            weight += w
            centre += (m - centre) * w / weight if weight > 0 else 0.0
        else:
            start[i], centre, weight = True, m, w
    bins = np.cumsum(start) - 1
    count = int(start.sum())
    total = np.bincount(bins, intensity, count)
    plain = np.bincount(bins, mz, count) / np.maximum(np.bincount(bins, minlength=count), 1)
    centres = np.where(total > 0, np.bincount(bins, intensity * mz, count) / np.where(total > 0, total, 1), plain)
    present_in = np.bincount(np.unique(np.stack([bins, spectrum]), axis=1)[0], minlength=count)
    stay = np.flatnonzero(present_in / n >= min_frac)
    if not len(stay):
        stay = np.sort(np.lexsort((centres, -total))[:FALLBACK])
    out = total[stay]
    return centres[stay], out / out.sum() if out.sum() > 0 else out


def consensus(members: DataFrame, mz_tol: float = 0.01, min_frac: float = 0.25, cluster: str = "cluster_id", pos: str = "pos", bin_lone: bool = False) -> DataFrame:
    """(cluster_id, num_merged, peaks): others are merged, a lone spectrum is sum-normalised and, with ``bin_lone``, its peaks are binned too."""
    kind = members.schema[cluster].dataType.simpleString()
    own = members.select(F.col(cluster).alias("cluster_id"), F.col(pos).alias("pos"), F.coalesce(sum_normalized(F.col("peaks")), F.array().cast(PEAKS)).alias("peaks"))
    # A row per cluster, its peaks pooled: as long as its spectra.
    pooled = own.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("pos", "peaks"))).alias("s"))
    flat = lambda f: F.flatten(F.transform("s", f))
    pooled = pooled.select(
        "cluster_id",
        F.size("s").alias("n"),
        flat(lambda x: F.transform(x["peaks"], lambda p: p["mz"])).alias("mz"),
        flat(lambda x: F.transform(x["peaks"], lambda p: p["intensity"])).alias("intensity"),
        flat(lambda x, i: F.transform(x["peaks"], lambda _: i)).alias("spectrum"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_pylist()
            cuts = (b.column(2).offsets.to_numpy() - b.column(2).offsets[0].as_py()).tolist()
            mz, x, s = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            out = []
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                got = mz[lo:hi], x[lo:hi]
                out.append(consensus_peaks(*got, s[lo:hi], n[i], mz_tol, min_frac) if (n[i] > 1 or bin_lone) and hi > lo else got)
            offsets = np.cumsum([0, *[len(o[0]) for o in out]]).astype(np.int32)
            both = [np.concatenate([o[j] for o in out]) if out else np.empty(0) for j in (0, 1)]
            peaks = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in both], ["mz", "intensity"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), peaks], names=["cluster_id", "num_merged", "peaks"])

    return pooled.mapInArrow(run, f"cluster_id {kind}, num_merged int, peaks {PEAKS.simpleString()}")


def combined_metadata(members: DataFrame, policy: str = "concat", cluster: str = "cluster_id", pos: str = "pos") -> DataFrame:
    """One row of metadata per cluster.

    Fields of the first spectrum; instrument, adduct and energy joined by ";"
    (``concat``) or by majority with the counts (``vote``; precursor_mz is then the median).
    """
    if policy not in ("concat", "vote"):
        raise ValueError(f"metadata_policy must be concat or vote, not {policy!r}")
    has = [f for f in FROM_FIRST if f in members.columns]
    # The first spectrum's value may be null, so the whole row is picked.
    first = F.min_by(F.struct(*has), F.col(pos)).alias("first") if has else F.lit(None).alias("first")
    aggs = [first, F.array_sort(F.collect_list(F.struct(pos, "spec_id"))).alias("sources")]
    if policy == "vote" and "precursor_mz" in has:
        aggs.append(median_or_first(F.col("precursor_mz"), F.col(pos)).alias("median_mz"))
    both = [f for f in COMBINED if f in members.columns]
    if policy == "concat":
        aggs += [F.array_sort(F.collect_list(F.when(F.col(f).isNotNull(), F.struct(pos, f)))).alias(f) for f in both]
    out = members.groupBy(cluster).agg(*aggs)
    columns = [cluster, F.transform("sources", lambda s: s["spec_id"]).alias("source_spec_ids")]
    columns += [(F.col("median_mz") if f == "precursor_mz" and policy == "vote" else F.col("first")[f]).alias(f) for f in has]
    if policy == "concat":
        columns += [F.nullif(F.array_join(F.col(f)[f], ";"), F.lit("")).alias(f) for f in both]
        return out.select(*columns)
    out = out.select(*columns)
    for f in both:
        votes = vote(members, cluster, f).select(cluster, F.col("mode").alias(f), F.col("hist").alias(f"{f}_hist"))
        out = out.join(votes, cluster, "left")
    return out


def merge_spectra(spectra: DataFrame, settings: MergeSettings = MergeSettings(), pos: str = "pos") -> DataFrame:
    """Consensus spectra of a table: (comp_id, cluster_id, num_merged, source_spec_ids, metadata, peaks)."""
    members = clusters(blocked(spectra, settings.merge_unannotated), settings, pos)
    peaks = consensus(members, settings.mz_tol, settings.min_frac, pos=pos)
    comp = members.groupBy("cluster_id").agg(F.first("comp_id").alias("comp_id"))
    return comp.join(combined_metadata(members, settings.metadata_policy, pos=pos), "cluster_id").join(peaks, "cluster_id")


def merge_mapped(spectra: DataFrame, mapping: DataFrame, done: DataFrame | None = None, settings: MergeSettings = MergeSettings(min_frac=0.5, metadata_policy="vote"), pos: str = "pos") -> DataFrame:
    """Consensus spectra of mapped spectra; compounds in ``done`` are skipped, so a stopped job goes on where it was."""
    mapped = spectra.drop("comp_id").join(mapping, "spec_id") if "comp_id" in spectra.columns else spectra.join(mapping, "spec_id")
    if done is not None:
        mapped = mapped.join(done.select("comp_id").distinct(), "comp_id", "left_anti")
    return merge_spectra(mapped, settings, pos)
