import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ionquarry.functions.tanimoto import tanimoto_from_minimum
from ionquarry.operators import index, peaks, topk
from ionquarry.plans.library import create_library, load_library
from ionquarry.plugins import Morgan, compute_fingerprints, external
from ionquarry.settings import FingerprintSettings
from ionquarry.sources import compounds, mgf, msp, spectra
from ionquarry.sources.memory import spectra_frame
from ionquarry.sources.tables import MOST_DELTAS, TableStore
from ionquarry.streaming.ingest import ingest_spectra

KEYS = ("AAAAAAAAAAAAAA-UHFFFAOYSA-N", "BBBBBBBBBBBBBB-UHFFFAOYSA-N")
RECORD = "BEGIN IONS\nCHARGE=1+\nSMILES=C=O\nCOMPOUND_NAME={name}\nIONMODE=positive\nCOLLISION_ENERGY=[20.0, 30.0]\nPRECURSOR_MZ={mz}\nINCHIKEY={key}\n{peaks}\nEND IONS\n\n"


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import test modules


class Model:
    def embed(self, spectra):
        return np.array([np.histogram(mz, bins=8, range=(0, 800), weights=x)[0] + 1e-3 for mz, x, _ in spectra])


class Generator:
    def fingerprint(self, smiles, inchi):
        text = smiles or inchi
        if text == "bad":
            raise ValueError(text)
        return {ord(c): text.count(c) for c in text}


@pytest.fixture(scope="module")
def mgf_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "ten.mgf"
    text = ""
    for i in range(10):
        peaks = "\n".join(f"{50 + 37 * j * (1 + i % 5):.4f} {1 + (i * j) % 7} " for j in range(1, 5))
        text += RECORD.format(name=f"n{i}", mz=100 + i, key=KEYS[i // 5], peaks=peaks)
    path.write_text(text)
    return str(path)


@pytest.fixture(scope="module")
def library(spark, mgf_file, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('out')}/lib"
    return create_library(spark, [mgf_file], folder, load_model=Model, load_generator=Generator, settings={"fragment_tol": 0.01})


def test_mgf(spark, mgf_file):
    rows = mgf.read(spark, mgf_file).orderBy("pos").collect()
    assert len(rows) == 10 and [r.name for r in rows] == [f"n{i}" for i in range(10)]
    first = rows[0]
    assert (first.smiles, first.charge, first.collision_energy, first.precursor_mz, first.n_peaks) == ("C=O", "1+", "[20.0, 30.0]", 100.0, 4)
    assert [p.mz for p in first.peaks] == sorted(p.mz for p in first.peaks)
    assert len({r.spec_id for r in rows}) == len({str(r.peaks) for r in rows})


def test_files_keep_their_order(spark, tmp_path):
    """The second file is larger and is read by several tasks; names need escapes."""
    one = lambda i, n: RECORD.format(name=f"n{i}", mz=100 + i, key=KEYS[0], peaks="\n".join(f"{50 + j} 1" for j in range(n))).replace("PRECURSOR_MZ=", "PEPMASS=")
    small, large = tmp_path / "a small.mgf", tmp_path / "b.mgf"
    small.write_text("".join(one(i, 2).replace("\nCHARGE", " 1000.0\nCHARGE") for i in range(3)))
    large.write_text("".join(one(i, 30) for i in range(3, 400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = mgf.read(spark, [str(small), str(large)]).orderBy("pos").collect()
        again = mgf.read(spark, [str(large), str(small)]).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.name for r in rows] == [f"n{i}" for i in range(400)] and rows[0].precursor_mz == 100
    assert [r.name for r in again] == [f"n{i}" for i in [*range(3, 400), 0, 1, 2]] and len({r.pos for r in rows}) == 400


def test_precursor_with_intensity(spark, tmp_path):
    (tmp_path / "x.mgf").write_text("BEGIN IONS\nPEPMASS=200.5 1000.0\n100 1\nEND IONS\nBEGIN IONS\nPEPMASS=n/a\n100 1\nEND IONS\n")
    assert [r.precursor_mz for r in mgf.read(spark, str(tmp_path / "x.mgf")).orderBy("pos").collect()] == [200.5, None]


MSP = "Name: a\nPrecursorMZ: 101.5\nComment: x: y\nNum Peaks: 3\n50.5 1; 40 2 ;60 3\n\nNAME: b\nPRECURSORTYPE: [M+H]+\nnum peaks: 2\n10\t1 \"note\"\n20,5\n"


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_msp(spark, tmp_path, ends):
    (tmp_path / "x.msp").write_bytes(f"\n{MSP}\n\n".replace("\n", ends).encode())
    a, b = msp.read(spark, str(tmp_path / "x.msp")).orderBy("pos").collect()
    assert (a.name, a.precursor_mz, [tuple(p) for p in a.peaks]) == ("a", 101.5, [(40.0, 2.0), (50.5, 1.0), (60.0, 3.0)])
    assert (b.name, b.adduct, [tuple(p) for p in b.peaks]) == ("b", "[M+H]+", [(10.0, 1.0), (20.0, 5.0)])


def test_formats_by_suffix(spark, tmp_path, mgf_file):
    (tmp_path / "x.msp").write_text(MSP)
    record = '{"Compound_Name": "j", "precursor_mz": "5.5", "peaks_json": "[[3.0, 1.0], [2.0, 4.0]]"}'
    (tmp_path / "y.json").write_text(f"[{record},\n{record}]\n")
    (tmp_path / "z.jsonl").write_text(f"{record}\n")
    rows = spectra.read(spark, [str(tmp_path / "z.jsonl"), mgf_file, str(tmp_path / "x.msp"), str(tmp_path / "y.json")]).orderBy("pos").collect()
    assert [r.name for r in rows] == ["j", *(f"n{i}" for i in range(10)), "a", "b", "j", "j"]
    assert (rows[0].precursor_mz, [tuple(p) for p in rows[0].peaks]) == (5.5, [(2.0, 4.0), (3.0, 1.0)])
    (tmp_path / "w.raw").write_text("")
    with pytest.raises(ValueError, match="raw"):
        spectra.read(spark, str(tmp_path / "w.raw"))


def test_compound_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("inchikey,smiles\nx,C\n")
    (tmp_path / "a.tsv").write_text("inchikey\tsmiles\nx\tC\n")
    for name in ("a.csv", "a.tsv"):
        assert compounds.read(spark, str(tmp_path / name)).columns == ["inchikey", "smiles", "pos"]
    with pytest.raises(ValueError):
        compounds.read(spark, str(tmp_path / "a.xlsx"))


def test_build_and_load(spark, library):
    back = load_library(spark, library.store.folder, Model, Generator)
    assert back.settings == library.settings and back.settings.fragment_tol == 0.01
    n = back.table("spectra").count()
    assert back.table("embeddings").count() == n and back.table("spec_to_comp").count() == n
    assert {r.comp_id for r in back.table("compounds").collect()} == {k[:14] for k in KEYS}
    assert back.metadata_by_comp_ids([KEYS[0][:14]]).columns[:2] == ["comp_id", "spec_id"]
    with pytest.raises(FileNotFoundError):
        load_library(spark, library.store.folder + "-none")


def test_searches(spark, library):
    ids = [r.spec_id for r in library.table("spectra").orderBy("spec_id").limit(3).collect()]
    hits = library.query_by_spec_ids(ids[::-1], k=2)
    top = {r.query_spec_id: (r.query_ix, r.spec_id, r.score) for r in hits.where("rank = 1").collect()}
    assert all(top[s][0] == 2 - i and top[s][1] == s and top[s][2] == pytest.approx(1) for i, s in enumerate(ids))
    queries = library.table("spectra").withColumn("pos", F.monotonically_increasing_id())
    assert library.query_compounds_by_spectra(queries, 5, 2).groupBy("query_ix").count().agg(F.max("count")).first()[0] <= 2
    distinct = library.query_compounds_by_spectra(queries, 5, 2, distinct_compounds=True)
    assert distinct.groupBy("query_ix", "comp_id").count().agg(F.max("count")).first()[0] == 1
    with pytest.raises(ValueError):
        library.query_compounds_by_spectra(queries, 2, 5)
    analogues = library.analogue_search(queries.limit(1), 2).collect()
    assert [r["rank"] for r in analogues] == [1, 2] and analogues[0].weighted_average_score > 0
    one = spark.createDataFrame([(0, "C=O")], "pos long, smiles string")
    assert library.query_compounds_by_compounds(one, 1).count() == 1
    with pytest.raises(ValueError):
        library.query_compounds_by_compounds(one.withColumn("inchi", F.lit("x")))


def test_sql_reads_only(library):
    assert library.sql("select count(*) as n from spectra").first().n > 0
    assert library.sql("with a as (select 1 as x) select (select max(x) from a) as y").first().y == 1
    assert library.sql("show tables").count() > 0 and library.sql("explain select 1").count() == 1
    bad = ["drop table spectra", "insert into spectra values (1)", "  create view x as select 1", "with a as (select 1) insert into spectra select * from a"]
    bad += ["from spectra insert overwrite directory '/tmp/never' using parquet select *", "cache table spectra", "set x = 1", "truncate table spectra"]
    for bad in bad:
        with pytest.raises(ValueError):
            library.sql(bad)


def test_guards(spark, library):
    bare = load_library(spark, library.store.folder)
    with pytest.raises(RuntimeError, match="model"):
        bare.query_spectra_by_spectra(bare.table("spectra").withColumn("pos", F.lit(0)))
    with pytest.raises(RuntimeError, match="fingerprints exist"):
        bare.set_fingerprint_settings(n_bits=1024)
    with pytest.raises(RuntimeError, match="needs the package"):
        external("a_package_that_is_not_there", "embedding")


def test_ingest_is_idempotent_and_backfill_counts_failures(spark, library):
    rows = library.table("spectra").withColumn("pos", F.monotonically_increasing_id())
    assert library.add_spectra(rows)["new"] == 0
    library.upsert_compounds(spark.createDataFrame([("C" * 14, "bad"), ("D" * 14, None)], "comp_id string, smiles string"))
    assert library.compute_missing_fingerprints() == {"attempted": 1, "updated": 0, "failed": 1, "skipped": 1}
    n = library.table("merged_spectra").count() + library.merge_mapped_spectra()
    assert n > 0 and library.merge_mapped_spectra() == 0


def test_stream_ingest(spark, library, tmp_path):
    source = str(tmp_path / "stream")
    extra = library.table("spectra").limit(2).unionByName(library.table("spectra").limit(1).withColumn("spec_id", F.lit("new")))
    extra.write.parquet(source)
    before = library.table("spectra").count()
    stream = spark.readStream.schema(extra.schema).parquet(source)
    ingest_spectra(stream, library.store, str(tmp_path / "cp")).awaitTermination()
    assert library.table("spectra").count() == before + 1


def test_dense_paths_agree(spark):
    rng = np.random.default_rng(1)
    lib = spark.createDataFrame([(f"s{i}", [float(v) for v in rng.normal(size=6)]) for i in range(80)] + [("zero", [0.0] * 6)], "spec_id string, vec array<double>")
    q = lib.limit(20).select(F.monotonically_increasing_id().alias("query_ix"), "vec")
    a = topk.dense(q, lib, 5).orderBy("query_ix", "rank").collect()
    assert a == topk.dense(q, lib, 5, broadcast=0).orderBy("query_ix", "rank").collect() and len(a) == 100
    wide = topk.dense(q, lib, 6).collect()
    assert {(r.query_ix, r.spec_id) for r in a} <= {(r.query_ix, r.spec_id) for r in wide}
    with pytest.raises(ValueError):
        topk.dense(q.withColumn("vec", F.array(F.lit(1.0))), lib, 5)
    assert topk.dense(q.where("false"), lib, 5).count() == 0
    near = topk.lsh(q, lib, 5, tables=32, bits=2).collect()
    assert len({(r.query_ix, r.spec_id) for r in near} & {(r.query_ix, r.spec_id) for r in a}) > 90


def test_sparse_search(spark):
    bits = spark.createDataFrame([("10", 0, 1.0), ("10", 2, 2.0), ("11", 1, 1.0), ("12", 2, 2.0), ("12", 3, 1.0)], "comp_id string, bit long, value double")
    q = bits.where("comp_id = '10'").withColumnRenamed("comp_id", "query_ix")
    got = topk.sparse(q, bits, 3).collect()
    assert [(r.comp_id, r.score) for r in got] == [("10", 1.0), ("12", pytest.approx(0.5))]
    assert topk.sparse(q.where("false"), bits, 3).count() == 0
    with pytest.raises(Exception, match="negative"):
        topk.sparse(q.withColumn("value", F.lit(-1.0)), bits, 3).collect()


def test_spectra_from_values(spark):
    one = spectra_frame(spark, {"mz": [2.0, 1.0], "intensities": [5.0, 6.0], "precursor_mz": "12.5", "collision_energy": 35.0, "ionmode": ""}).first()
    assert ([tuple(p) for p in one.peaks], one.precursor_mz, one.collision_energy, one.ionmode) == ([(1.0, 6.0), (2.0, 5.0)], 12.5, "35.0", None)
    assert spectra_frame(spark, []).count() == 0
    for bad in ({"mz": [1.0], "intensities": []}, "text", [1], 5):
        with pytest.raises(ValueError):
            spectra_frame(spark, bad)


def test_writers_and_indexes(spark, library):
    with pytest.raises(ValueError):
        library.upsert_many([{"inchikey": KEYS[0], "smiles": "never"}, {"inchikey": "short"}])
    assert library.compound(KEYS[0][:14])["smiles"] != "never"
    assert library.upsert_compound(inchikey="EEEEEEEEEEEEEE-X", smiles="CO", fp_bits=[1, 4294967295], fp_values=[1.0, 2.0]) == "E" * 14
    library.upsert_compound(inchikey="EEEEEEEEEEEEEE-Y", smiles=None, fp_bits=[])
    row = library.fingerprints_by_ids(["E" * 14, "none"]).collect()
    assert row[0].fp_bits == [1, 4294967295] and row[1].fp_bits is None and library.compound("E" * 14)["smiles"] == "CO"
    some = library.table("spectra").first()
    assert library.fragments_by_spec_ids([some.spec_id], single=True).schema["peaks"].dataType.elementType["mz"].dataType.simpleString() == "float"
    assert [r.comp_id for r in library.compounds_by_ids(["E" * 14, KEYS[0][:14], "E" * 14, "none"]).collect()] == [KEYS[0][:14], "E" * 14]
    library.link_many([("a", "E" * 14), ("a", "F" * 14)])
    assert [r.comp_id for r in library.all_mappings().where("spec_id = 'a'").collect()] == ["F" * 14]
    with pytest.raises(ValueError):
        library.link("a", "short")
    ids = [r.spec_id for r in library.table("embeddings").limit(2).collect()]
    plain = library.query_by_spec_ids(ids, 3).orderBy("query_ix", "rank").collect()
    asked = spark.createDataFrame([(0, [1], [1.0])], "pos long, fp_bits array<bigint>, fp_values array<float>")
    near = library.query_compounds_by_compounds(asked, 2).collect()
    assert near[0].comp_id == "E" * 14
    assert library.build_embedding_index() == library.table("embeddings").count() and library.build_fingerprint_index() >= 3
    assert {r.comp_id: r.l1 for r in library.fingerprint_norms().collect()}["E" * 14] == 3 and library.fingerprint("E" * 14) == {1: 1.0, 4294967295: 2.0}
    assert library.fingerprint("none") is None
    back = load_library(spark, library.store.folder)
    again = back.query_by_spec_ids(ids, 3).orderBy("query_ix", "rank").collect()
    assert [(r.query_ix, r.spec_id) for r in again] == [(r.query_ix, r.spec_id) for r in plain]
    assert back.query_compounds_by_compounds(asked, 2).collect() == near
    back.set_embedding_index(back.embedding_index(probes=1))
    assert back.query_by_spec_ids(ids, 3).where("rank = 1").count() == 2
    back.set_embedding_index(None)
    back.set_fingerprint_index("compounds", spark.createDataFrame([("Z", 1, 1.0)], "comp_id string, bit long, value double"))
    assert [r.comp_id for r in back.query_compounds_by_compounds(asked, 2).collect()] == ["Z"]
    back.set_fingerprint_index("compounds", None)
    graph = back.compound_graph(3).where("rank = 1").collect()
    assert all(r.node == r.neighbour and r.distance == 0 for r in graph)
    with pytest.raises(ValueError, match="No rows"):
        library.build_embedding_index("WHERE spec_id = 'nothing'")
    with pytest.raises(RuntimeError, match="umap"):
        back.compound_layout()
    assert library.unique_compounds(spark.createDataFrame([(KEYS[0][:14], 1)], "inchikey14 string, tag int")).where("tag = 1").count() == 1
    assert library.compute_missing_embeddings(only_missing=False) == library.table("spectra").count()


def test_manifest_is_replaced_in_one_step(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    store = TableStore.create(spark, folder)
    store.replace("spec_to_comp", spark.createDataFrame([("a", "A" * 14)], "spec_id string, comp_id string"))
    one, two = TableStore.load(spark, folder), TableStore.load(spark, folder)
    new = spark.createDataFrame([("b", "B" * 14)], "spec_id string, comp_id string")
    one.append("spec_to_comp", new)
    with pytest.raises(RuntimeError, match="another writer"):
        two.append("spec_to_comp", new)
    assert TableStore.load(spark, folder).read("spec_to_comp").count() == 2
    for i in range(MOST_DELTAS + 1):
        one.change("spec_to_comp", spark.createDataFrame([("a", chr(65 + i) * 14)], "spec_id string, comp_id string"))
    assert len(one.manifest["deltas"]["spec_to_comp"]) == 1
    assert one.vacuum() > 0 and one.vacuum() == 0
    with pytest.raises(KeyError), one.transaction():
        one.replace("spec_to_comp", new)
        one.read("nothing")
    assert one.read("spec_to_comp").count() == TableStore.load(spark, folder).read("spec_to_comp").count() == 2
    at = one.number
    with one.transaction():
        one.append("embeddings", spark.createDataFrame([("a", 1, [1.0])], "spec_id string, d int, vec array<float>"))
        one.append("embeddings", spark.createDataFrame([("b", 1, [2.0])], "spec_id string, d int, vec array<float>"))
    assert one.number == at + 1 and TableStore.load(spark, folder).read("embeddings").count() == 2
    assert {r.spec_id: r.comp_id for r in TableStore.load(spark, folder).read("spec_to_comp").collect()} == {"a": "I" * 14, "b": "B" * 14}


def test_index_recall(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 16)) * 3
    lib = spark.createDataFrame([(i, [float(x) for x in middles[i % 30] + rng.normal(size=16)]) for i in range(3000)], "spec_id long, vec array<double>")
    q = lib.where("spec_id % 50 = 0").select(F.col("spec_id").alias("query_ix"), "vec")
    found = index.VectorIndex(*index.build(lib, cells=40))
    exact = {(r.query_ix, r.spec_id) for r in topk.dense(q, lib, 10).collect()}
    assert found.size == 3000 and {(r.query_ix, r.spec_id) for r in found.query(q, 10).collect()} == exact
    near = {(r.query_ix, r.spec_id) for r in found.query(q, 10, probes=8).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    with pytest.raises(ValueError):
        found.query(q.withColumn("vec", F.array(F.lit(1.0))), 10, probes=2)
    with pytest.raises(ValueError):
        index.build(lib.where("false"))


def _sparse_rows(spark, seed, n, name):
    rng = np.random.default_rng(seed)
    rows = [(f"{name}{i}", sorted(rng.choice(60, rng.integers(0, 12), replace=False).tolist())) for i in range(n)]
    return spark.createDataFrame([(i, b, [float(x) for x in rng.integers(1, 5, len(b))]) for i, b in rows], f"{name} string, bits array<bigint>, vals array<double>")


@pytest.mark.parametrize("broadcast", [topk.BROADCAST, 0])
def test_sparse_scores_equal_brute_force(spark, broadcast, monkeypatch):
    monkeypatch.setattr(topk, "AT_ONCE", 500)
    monkeypatch.setattr(topk, "SPARSE_BLOCK", 16)
    monkeypatch.setattr(topk, "BLOCK", 25)
    q, lib = _sparse_rows(spark, 1, 40, "q"), _sparse_rows(spark, 2, 70, "c")
    want = {}
    for a in q.collect():
        for b in lib.collect():
            x, y = dict(zip(a.bits, a.vals)), dict(zip(b.bits, b.vals))
            low = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
            if low:
                dot = sum(x[k] * y[k] for k in x.keys() & y.keys())
                cos = dot / (sum(v * v for v in a.vals) * sum(v * v for v in b.vals)) ** 0.5
                want[a.q, b.c] = (low / (sum(a.vals) + sum(b.vals) - low), cos)
    got = {(r.q, r.c): (r.tanimoto, r.cosine) for r in topk.sparse_scores(q, lib, "q", "c", broadcast=broadcast).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    best = {(r.q, r["rank"]): r.c for r in topk.scan(q, lib, 3, "q", "c", broadcast).collect()}
    for a in {k[0] for k in want}:
        order = sorted((-round(s, 10), c) for (x, c), (s, _) in want.items() if x == a)[:3]
        assert [best[a, i] for i in range(1, len(order) + 1)] == [c for _, c in order]
    assert topk.sparse_scores(topk.unpacked(q, "q"), topk.unpacked(lib, "c"), "q", "c").count() == len(want)


def test_dense_best_paths_agree(spark):
    rng = np.random.default_rng(5)
    lib = spark.createDataFrame([(f"s{i}", f"c{i % 7}", [float(x) for x in rng.normal(size=5)]) for i in range(60)], "spec_id string, comp_id string, vec array<double>")
    q = lib.limit(9).select(F.monotonically_increasing_id().alias("query_ix"), "vec")
    a = topk.dense_best(q, lib).orderBy("query_ix", "comp_id").collect()
    assert a == topk.dense_best(q, lib, broadcast=0).orderBy("query_ix", "comp_id").collect() and len(a) == 63


@pytest.mark.parametrize("sub", [peaks.SUB_BLOCK, 3])
def test_block_scores_equal_pairs(spark, sub, monkeypatch):
    monkeypatch.setattr(peaks, "SUB_BLOCK", sub)
    monkeypatch.setattr(peaks, "AT_ONCE", 40)
    rng = np.random.default_rng(7)
    rows = []
    for i in range(40):
        n = int(rng.integers(0, 9))
        rows.append((i, "k" if i % 3 else None, [(float(m), float(x)) for m, x in zip(rng.integers(0, 30, n) / 2, rng.integers(1, 4, n))]))
    rows.append((40, "alone", [(1.0, 1.0)]))
    df = spark.createDataFrame(rows, "pos long, key string, peaks array<struct<mz:double,intensity:double>>").repartition(3)
    monkeypatch.setitem(peaks.SCORERS, "slow", peaks.SCORERS["cosine_greedy"])
    facts = lambda name: {(r.a, r.b): round(r.score, 9) for r in peaks.pair_scores(df, ["key"], scorer=name, tol=0.5, mz_power=0.5, intensity_power=0.5).collect()}
    flat = df.withColumn("peaks", F.array_sort("peaks"))
    own = {(r.a, r.b): round(r.score, 9) for r in peaks.pair_scores(flat, ["key"], scorer="slow", tol=0.5, mz_power=0.5, intensity_power=0.5).collect()}
    got = facts("cosine_greedy")
    assert got == own and len(got) == 14 * 13 // 2 + 26 * 25 // 2
    some = peaks.pair_scores(df, ["key"], tol=0.5, mz_power=0.5, intensity_power=0.5, least=0.5).collect()
    assert {(r.a, r.b) for r in some} == {k for k, s in got.items() if s >= 0.5}


class Sized:
    """A generator that makes what its settings say."""

    def __init__(self, given):
        self.given = given

    def fingerprint(self, smiles, inchi):
        counts = {ord(c) % self.given.n_bits: (smiles or inchi).count(c) for c in smiles or inchi}
        return counts if self.given.sparse else [counts.get(i, 0) for i in range(self.given.n_bits)]


def test_fingerprint_settings_reach_the_generator(spark):
    rows = spark.createDataFrame([("a", "CCO", None)], "comp_id string, smiles string, inchi string")
    made = lambda **kw: compute_fingerprints(rows, Sized, FingerprintSettings(**kw)).first()
    assert (made(n_bits=64).fp_bits, made(n_bits=64).fp_values) == ([3, 15], [2.0, 1.0])
    assert made(n_bits=64, count=False).fp_values == [1.0, 1.0]
    assert made(n_bits=64, scaling="log", weights={3: 10.0}).fp_values == pytest.approx([10 * np.log(3), np.log(2)])
    assert made(n_bits=64, sparse=False).fp_dense == [2.0 if i == 3 else 1.0 if i == 15 else 0.0 for i in range(64)]
    weights = [2.0] * 64
    assert made(n_bits=64, sparse=False, scaling="log", weights=weights).fp_dense[3] == pytest.approx(2 * np.log(3))
    for bad, error in (({"count": False, "scaling": "log"}, NotImplementedError), ({"scaling": "x"}, ValueError), ({"weights": [1.0]}, TypeError), ({"sparse": False, "n_bits": 2, "weights": [1.0]}, ValueError)):
        with pytest.raises(error):
            FingerprintSettings(**bad)
    with pytest.raises(RuntimeError, match="rdkit"):
        Morgan(FingerprintSettings())


def test_scorer_by_name(spark, monkeypatch):
    from ionquarry.operators import merging
    from ionquarry.settings import MergeSettings

    monkeypatch.setitem(peaks.SCORERS, "always", lambda a, b, **kw: F.lit(1.0))
    rows = spark.createDataFrame([(i, KEYS[i % 2], []) for i in range(6)], "pos long, inchikey string, peaks array<struct<mz:double,intensity:double>>")
    rows = rows.withColumns({"ionmode": F.lit("p"), "charge": F.lit("1")})
    found = merging.clusters(merging.blocked(rows), MergeSettings(scorer="always")).collect()
    assert {r.pos: r.cluster_id for r in found} == {i: i % 2 for i in range(6)}


def test_tanimoto_of_sums(spark):
    assert spark.range(1).select(tanimoto_from_minimum(F.lit(1.0), F.lit(2.0), F.lit(3.0))).first()[0] == 0.25
