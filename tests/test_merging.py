import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ionquarry.operators import merging, peaks
from ionquarry.operators.components import components
from ionquarry.settings import MergeSettings

PEAKS = "array<struct<mz:double,intensity:double>>"


def frame(spark, clusters):
    return spark.createDataFrame([(c, i, p) for i, (c, p) in enumerate(clusters)], f"cluster_id int, pos int, peaks {PEAKS}")


def merged(spark, clusters, **kw):
    got = merging.consensus(frame(spark, clusters), kw.pop("mz_tol", 0.01), kw.pop("min_frac", 0.5)).collect()
    return {r.cluster_id: (r.num_merged, [(p.mz, p.intensity) for p in r.peaks]) for r in got}


def test_identical_peaks_add_up(spark):
    n, ps = merged(spark, [(1, [(100.0, 10.0), (150.0, 5.0)]), (1, [(100.0, 20.0), (150.0, 5.0)])])[1]
    assert n == 2 and len(ps) == 2 and sum(p[1] for p in ps) == pytest.approx(1)
    assert ps[0][1] / ps[1][1] == pytest.approx((10 / 15 + 20 / 25) / (5 / 15 + 5 / 25))


def test_rare_peaks_go_and_near_ones_join(spark):
    only = [(100.0, 1.0)]
    got = merged(spark, [(1, [(100.0, 1.0), (200.0, 1.0)]), (1, only), (1, only), (1, only), (2, [(100.0, 1.0)]), (2, [(100.007, 1.0)])])
    assert [p[0] for p in got[1][1]] == [100.0]
    assert len(got[2][1]) == 1 and 100 < got[2][1][0][0] < 100.007


def test_fallback_empty_and_single(spark):
    got = merged(spark, [(1, [(100.0, 1.0)]), (1, [(150.0, 1.0)]), (1, [(200.0, 1.0)]), (2, []), (2, []), (3, [(50.0, 2.0), (60.0, 6.0)])])
    assert [p[0] for p in got[1][1]] == [100.0, 150.0, 200.0]
    assert got[2] == (2, []) and got[3] == (1, [(50.0, 0.25), (60.0, 0.75)])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(1, 1000), st.floats(0.01, 100), st.integers(0, 3)), min_size=1, max_size=40))
def test_consensus_sums_to_one(rows):
    mz, x, s = (np.array(c, dtype=float) for c in zip(*rows, strict=True))
    out_mz, out = merging.consensus_peaks(mz, x, s.astype(int), 4, 0.01, 0.25)
    assert out.sum() == pytest.approx(1) and (np.diff(out_mz) >= 0).all()


def test_greedy_cosine():
    a = (np.array([100.0, 200.0]), np.array([2.0, 3.0]))
    assert peaks.greedy_cosine(a, a, 0.1, 0, 1) == (pytest.approx(1), 2)
    b = (np.array([100.05, 100.08]), np.array([1.0, 2.0]))
    score, n = peaks.greedy_cosine(a, b, 0.1, 0, 1)
    assert n == 1 and score == pytest.approx(4 / np.sqrt(13 * 5))
    assert peaks.greedy_cosine((np.array([]), np.array([])), a, 0.1, 0, 1) == (0.0, 0)


def test_tolerance_join_is_complete(spark):
    rng = np.random.default_rng(0)
    a = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.uniform(0, 50, 60))], "i int, mz double")
    got = {(r.i, r.i_r) for r in peaks.tolerance_join(a, a, 0.7).collect()}
    v = [r.mz for r in a.orderBy("i").collect()]
    assert got == {(i, j) for i in range(60) for j in range(60) if abs(v[i] - v[j]) <= 0.7}


def test_components_chain_and_loop(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 201: 200}
    assert components(edges.where("false")).count() == 0


def test_merge_spectra_blocks_by_compound_mode_and_charge(spark):
    p = [(100.0, 1.0), (150.0, 2.0)]
    rows = [(0, "a", p, "K" * 14 + "-X", "Positive", "1", 10.0, "q"), (1, "b", p, "K" * 14 + "-X", "positive", "1", 12.0, "r"), (2, "c", p, "K" * 14 + "-X", "negative", "1", 11.0, "q"), (3, "d", p, None, "positive", "1", 9.0, "q")]
    df = spark.createDataFrame(rows, f"pos long, spec_id string, peaks {PEAKS}, inchikey string, ionmode string, charge string, precursor_mz double, adduct string")
    got = sorted((r.num_merged, r.source_spec_ids, r.adduct, r.precursor_mz) for r in merging.merge_spectra(df).collect())
    assert got == [(1, ["c"], "q", 11.0), (2, ["a", "b"], "q;r", 10.0)]
    vote = merging.merge_spectra(df, MergeSettings(metadata_policy="vote")).where("num_merged = 2").first()
    assert (vote.adduct, vote.adduct_hist, vote.precursor_mz) == ("r", {"q": 1, "r": 1}, 11.0)
    assert merging.merge_spectra(df, MergeSettings(merge_unannotated=True)).count() == 3
    done = spark.createDataFrame([("K" * 14,)], "comp_id string")
    mapping = spark.createDataFrame([("a", "K" * 14), ("c", "L" * 14)], "spec_id string, comp_id string")
    assert [r.comp_id for r in merging.merge_mapped(df, mapping, done).collect()] == ["L" * 14]
    with pytest.raises(ValueError):
        merging.combined_metadata(df.withColumn("cluster_id", F.lit(1)), "other")
