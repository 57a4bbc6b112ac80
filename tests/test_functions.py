import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ionquarry.functions import codecs, fingerprints, keys, tanimoto, vectors
from ionquarry.operators import aggregate, lookup, topk, writes
from ionquarry.settings import FingerprintSettings, MergeSettings


def one(spark, column, values="values (1) as t(x)"):
    return spark.sql(f"select * from {values}").select(column.alias("r")).first()[0]


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("key", "want"),
    [(None, None), ("", None), ("abcdefghijklmn-UH-N", "ABCDEFGHIJKLMN"), (" abcdefghijklmnop ", "ABCDEFGHIJKLMN"), ("short", None), ("AB-C", "AB"), ("-X", ""), ("abcdefghijklmnopq-X", "ABCDEFGHIJKLMN")],
)
def test_inchikey14(spark, key, want):
    df = spark.createDataFrame([(key,)], "k string")
    assert df.select(keys.inchikey14(F.col("k"))).first()[0] == want


def test_metadata_normalisation(spark):
    df = spark.createDataFrame([({"precursor_mz": "nan", "ionmode": "", "charge": "1+", "compound_name": "x"},), ({"precursor_mz": "12.5"},)], "m map<string,string>")
    got = df.select(*keys.normalized_metadata(F.col("m"), ("precursor_mz", "ionmode", "charge", "name"), {"name": ("compound_name",)})).collect()
    assert [tuple(r) for r in got] == [(None, None, "1+", "x"), (12.5, None, None, None)]
    assert keys.strip_where(" WHERE a > 1") == "a > 1" and keys.strip_where("a > 1") == "a > 1"


def test_vectors(spark):
    df = spark.sql("select array(3.0D, 4.0D) a, array(0.0D, 0.0D) z, array(named_struct('mz', 1.0D, 'intensity', 1.0D), named_struct('mz', 2.0D, 'intensity', 3.0D)) p")
    r = df.select(vectors.l2_normalized(F.col("a")), vectors.l2_normalized(F.col("z")), vectors.cosine(F.col("a"), F.col("a")), vectors.cosine(F.col("a"), F.col("z")), vectors.sum_normalized(F.col("p"))).first()
    assert r[0] == [0.6, 0.8] and r[1] == [0.0, 0.0] and math.isclose(r[2], 1) and r[3] is None
    assert [p.intensity for p in r[4]] == [0.25, 0.75]


def test_tanimoto_conventions_for_empty(spark):
    df = spark.sql("select array(0D, 0D) a, array(1D, 2D) b, array(2D, 1D) c, 0D z, 3D s, 2D d")
    c = F.col
    assert df.select(tanimoto.tanimoto_dense(c("a"), c("a"))).first()[0] is None
    assert df.select(tanimoto.tanimoto_dense(c("a"), c("a"), empty=1.0)).first()[0] == 1.0
    assert df.select(tanimoto.tanimoto_dense(c("b"), c("c"))).first()[0] == 0.5
    assert df.select(tanimoto.tanimoto_from_manhattan(c("z"), c("z"), c("z"))).first()[0] == 1.0
    assert df.select(tanimoto.tanimoto_from_manhattan(c("s"), c("s"), c("d"))).first()[0] == 0.5
    assert df.select(tanimoto.tanimoto_from_minimum(c("z"), c("z"), c("z"))).first()[0] == 0.0
    sparse = spark.sql("select array(1L, 2L) a, array(1f, 2f) x, array(2L, 3L) b, array(1f, 4f) y")
    assert math.isclose(sparse.select(tanimoto.tanimoto_sparse(c("a"), c("x"), c("b"), c("y"))).first()[0], 1 / 7)


def test_prepared_fingerprint(spark):
    df = spark.sql("select map(7L, 3L, 1L, 2L, 4L, 5L) m")
    f = df.select(fingerprints.prepared(F.col("m"), "log", {1: 10.0, 4: 0.5})).first()[0]
    assert f.bits == [1, 4, 7]
    assert f["values"] == pytest.approx([10 * math.log1p(2), 0.5 * math.log1p(5), math.log1p(3)], rel=1e-6)
    with pytest.raises(ValueError):
        fingerprints.prepared(F.col("m"), "sqrt")
    with pytest.raises(TypeError):
        fingerprints.prepared(F.col("m"), None, [1.0])
    dense = spark.sql("select array(0, 2, 5, 0) c").select(fingerprints.scaled_dense(F.col("c"), "log", [1, 2, 0.5, 1])).first()[0]
    assert dense == pytest.approx([0, 2 * math.log1p(2), 0.5 * math.log1p(5), 0], rel=1e-6)


def test_fingerprint_statistics(spark):
    bits = spark.createDataFrame([(0, 1), (0, 3), (0, 5), (1, 3), (1, 4), (2, 1), (2, 4), (2, 6)], "row int, bit long")
    assert rows(aggregate.document_frequency(bits)) == [(1, 2, 0), (3, 2, 0), (4, 2, 1), (5, 1, 0), (6, 1, 2)]
    dense = spark.createDataFrame([([1, 1, 0, 0],), ([0, 2, 0, 1],), ([1, 0, 0, 1],)], "counts array<int>")
    got = {r.bit: r.idf for r in aggregate.idf_dense(dense).collect()}
    assert math.isclose(got[2], math.log(3)) and math.isclose(got[1], math.log(1.5))


def test_coalesce_and_l1(spark):
    bits = spark.createDataFrame([(0, 3, 0.5), (0, 1, 2.0), (0, 1, 3.0), (2, 0, 1.0), (2, 4, 1.0)], "id int, bit long, value double")
    assert sorted(rows(aggregate.coalesced(bits, "id", 5))) == [(0, 1, 5.0), (0, 3, 0.5), (2, 0, 1.0), (2, 4, 1.0)]
    with pytest.raises(Exception, match="bit out of range"):
        aggregate.coalesced(spark.createDataFrame([(0, 6, 1.0)], "id int, bit long, value double"), "id", 5).collect()
    assert sorted(rows(aggregate.l1_norms(bits, "id"))) == [(0, 5.5), (2, 2.0)]


def test_merged_fingerprints(spark):
    bits = spark.createDataFrame([(0, "a", 1, 2.0), (0, "a", 2, 4.0), (0, "b", 1, 4.0)], "g int, c string, bit long, value double")
    weights = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0)], "g int, c string, weight double")
    assert sorted(rows(aggregate.merged_fingerprints(bits, "g", "c", weights))) == [(0, 1, 3.5), (0, 2, 1.0)]
    assert sorted(rows(aggregate.merged_fingerprints(bits, "g", "c"))) == [(0, 1, 3.0), (0, 2, 2.0)]
    with pytest.raises(Exception, match="more than 0"):
        aggregate.merged_fingerprints(bits, "g", "c", weights.withColumn("weight", F.lit(0.0))).collect()


def test_vote_ties_go_to_the_greatest(spark):
    df = spark.createDataFrame([(1, " b "), (1, "z"), (1, ""), (1, None), (2, None)], "k int, v string")
    assert rows(aggregate.vote(df, "k", "v")) == [(1, "z", {"b": 1, "z": 1})]


def test_request_rules(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "spec_id string, n int")
    asked = lookup.request(spark, ["c", "missing", "a", "c"])
    assert [(r.pos, r.n) for r in lookup.in_request_order(table, asked).collect()] == [(0, 3), (2, 1), (3, 3)]
    assert [(r.pos, r.n) for r in lookup.row_for_each(table, asked).collect()] == [(0, 3), (1, None), (2, 1), (3, 3)]
    assert [(r.pos, r.spec_id) for r in lookup.last_position(table, asked, "spec_id").collect()] == [(2, "a"), (3, "c")]


def test_dimensions(spark):
    mixed = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0])], "spec_id string, vec array<double>")
    with pytest.raises(ValueError, match="Mixed"):
        lookup.one_dimension(mixed)
    with pytest.raises(ValueError, match="No rows"):
        lookup.one_dimension(mixed.where("false"), may_be_empty=False)
    with pytest.raises(ValueError):
        lookup.embeddings_by_ids(mixed)


def test_upsert_and_keep(spark):
    old = spark.createDataFrame([("k1", "s", [1]), ("k2", None, None)], "comp_id string, smiles string, fp_bits array<int>")
    new = spark.createDataFrame([("k1", None, []), ("k2", "t", [2]), ("k3", "u", None)], "comp_id string, smiles string, fp_bits array<int>")
    got = {r.comp_id: (r.smiles, r.fp_bits) for r in writes.upsert(old, new, "comp_id").collect()}
    assert got == {"k1": ("s", [1]), "k2": ("t", [2]), "k3": ("u", None)}


def test_overwrite_rules(spark):
    wide = spark.createDataFrame(
        [(0, "AAAAAAAAAAAAAA", "C", "x"), (1, "SHORT", "CC", "y"), (2, " BBBBBBBBBBBBBB", "CCC", "z"), (3, "AAAAAAAAAAAAAA", "CCCC", "w")],
        "pos long, nchikey string, smiles string, cf_class string",
    )
    got = {r.comp_id: (r.smiles, r.classyfire_class, r.inchikey) for r in writes.overwrite_compounds(wide, {"classyfire_class": "cf_class"}).collect()}
    assert got == {"AAAAAAAAAAAAAA": ("CCCC", "w", None), "BBBBBBBBBBBBBB": ("CCC", "z", None)}
    assert tuple(writes.overwrite_stats(wide).first()) == (4, 2, 2, 1)
    with pytest.raises(ValueError):
        writes.overwrite_compounds(wide.select("pos", "smiles"))


def test_links_check_keys(spark):
    empty = spark.createDataFrame([], "spec_id string, comp_id string")
    good = spark.createDataFrame([(0, 123, "A" * 14), (1, 124, "A" * 14), (2, 123, "B" * 14)], "pos long, spec_id long, comp_id string")
    assert sorted(rows(writes.links(empty, good))) == [("123", "B" * 14), ("124", "A" * 14)]
    with pytest.raises(Exception, match="14-character"):
        writes.links(empty, good.withColumn("comp_id", F.lit("short"))).collect()


def test_codecs_round_trip(spark):
    df = spark.createDataFrame([([1.5, 2.0], [4294967295, 1], [3, -1]), ([], [], []), (None, None, None)], "f array<float>, b array<bigint>, c array<int>")
    back = df.select(
        codecs.floats_from_bytes(codecs.floats_to_bytes(F.col("f"))), codecs.bits_from_bytes(codecs.bits_to_bytes(F.col("b"))),
        codecs.counts_from_bytes(codecs.counts_to_bytes(F.col("c"))), codecs.npy_from_bytes(codecs.npy_to_bytes(F.col("f"))),
    ).collect()
    assert tuple(back[0]) == ([1.5, 2.0], [4294967295, 1], [3, -1], [1.5, 2.0])
    assert tuple(back[1]) == ([], [], [], []) and tuple(back[2]) == (None, None, None, None)


def test_settings():
    s = MergeSettings.of({"min_frac": 0.5})
    assert (s.mz_tol, s.min_frac, s.cosine_threshold, s.intensity_power, s.normalize_sum) == (0.01, 0.5, 0.95, 0.5, True)
    with pytest.raises(TypeError):
        MergeSettings.of({"nonsense": 1})
    assert FingerprintSettings().n_bits == 4096


@settings(max_examples=12, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 12), st.integers(1, 5), min_size=1, max_size=6), min_size=2, max_size=5))
def test_tanimoto_is_symmetric_bounded_and_one_on_itself(spark, maps):
    bits = spark.createDataFrame([(f"c{i}", b, float(v)) for i, m in enumerate(maps) for b, v in m.items()], "comp_id string, bit long, value double")
    pairs = topk.tanimoto_pairs(bits.withColumnRenamed("comp_id", "query_ix"), bits)
    got = {(r.query_ix, r.comp_id): r.score for r in pairs.collect()}
    for (a, b), s in got.items():
        assert s == pytest.approx(got[(b, a)]) and 0 < s <= 1 + 1e-12
        low = sum(min(maps[int(a[1:])].get(k, 0), v) for k, v in maps[int(b[1:])].items())
        high = sum(maps[int(a[1:])].values()) + sum(maps[int(b[1:])].values()) - low
        assert s == pytest.approx(low / high)
    assert all(got[(f"c{i}", f"c{i}")] == pytest.approx(1) for i in range(len(maps)))
    best = topk.scan(bits.withColumnRenamed("comp_id", "query_ix"), bits, 2)
    assert {(r.query_ix, r.comp_id): r.score for r in best.collect()}.items() <= {k: round(s, topk.DIGITS) for k, s in got.items()}.items()
