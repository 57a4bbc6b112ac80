"""Queries against their SQL on tables that have what the small ones lack."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracle import DATA, _plain

import __spark_entry__ as entry
from ionquarry import storage
from ionquarry.operators import topk

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def agree(spark, folder, name, **tables):
    """Query and SQL over the smallest tables, some replaced by a SELECT; their rows."""
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    for p in DATA.glob("*.parquet"):
        if p.stem in tables:
            con.execute(f"copy ({tables[p.stem]}) to '{folder}/{p.name}' (format parquet)")
        else:
            (folder / p.name).symlink_to(p)
    for t in tables:
        con.execute(f"create or replace view {t} as select * from '{folder}/{t}.parquet'")
    got, found = entry.queries()[name](spark, str(folder)), con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    rows = _plain([tuple(r) for r in got.collect()], got.columns)
    assert sorted(got.columns) == sorted(names) and rows == _plain(found.fetchall(), names)
    return rows


ORDERS = """select i + 1 as o_orderkey, 1::bigint as o_custkey, 'O' as o_orderstatus, 10.0::double as o_totalprice, timestamp '1998-02-06' as o_orderdate, 'x' as o_orderpriority from range(3) t(i)"""


def lines(*peaks):
    """Rows (order, line, m/z, intensity) as lineitem."""
    one = "select {}::bigint as l_orderkey, 1::bigint as l_partkey, 1::bigint as l_suppkey, {}::integer as l_linenumber, {}::double as l_quantity, {}::double as l_extendedprice"
    return " union all ".join(one.format(o, n, x, mz * 100) for o, n, mz, x in peaks)


@pytest.mark.parametrize("name,n", [("similarity_clusters", 3), ("merged_spectra_of_library", 2)])
def test_threshold_compares_rounded_scores(spark, tmp_path, name, n):
    """One common peak: the cosine is sqrt(90 / 1000.002), 0.2999997 before rounding."""
    made = lines((1, 1, 100, 90), (1, 2, 500, 910.002), (2, 1, 100, 7), (3, 1, 900, 5))
    assert len(agree(spark, tmp_path, name, orders=ORDERS, lineitem=made)) == n


def test_equal_lines_count_once(spark, tmp_path):
    made = lines((1, 1, 100, 3), (1, 1, 100, 3), (1, 2, 100, 3), (1, 1, 200, 2), (2, 1, 900, 5))
    assert len(agree(spark, tmp_path, "peak_sum_normalize", orders=ORDERS, lineitem=made)) == 4


def test_near_peaks_of_a_lone_spectrum_join(spark, tmp_path):
    made = lines((1, 1, 100, 3), (1, 2, 101, 1), (1, 3, 500, 4))
    assert len(agree(spark, tmp_path, "consensus_spectra", orders=ORDERS, lineitem=made)) == 2


def test_dense_scores_come_in_slices(monkeypatch):
    monkeypatch.setattr(topk, "AT_ONCE", 100)
    rng = np.random.default_rng(3)
    q, lib, ids = rng.normal(size=(50, 4)), rng.integers(-1, 2, (20, 4)).astype(float), np.array([f"s{(i * 7) % 20}" for i in range(20)])
    parts = list(topk._nearest(q, lib, ids, 3))
    assert len(parts) == 10
    s = np.round(q @ lib.T, topk.DIGITS)
    want = [(i, ids[j], s[i, j]) for i in range(50) for j in sorted(range(20), key=lambda j, i=i: (-s[i, j], ids[j]))[:3]]
    assert [(i, ids[j], x) for r, c, v in parts for i, j, x in zip(r, c, v, strict=True)] == want


def test_best_of_groups_comes_in_slices(monkeypatch):
    monkeypatch.setattr(topk, "AT_ONCE", 100)
    rng = np.random.default_rng(4)
    q, lib, starts = rng.normal(size=(50, 4)), rng.integers(-1, 2, (20, 4)).astype(float), np.array([0, 3, 4, 15])
    parts = list(topk._best_of_groups(q, lib, starts))
    assert len(parts) == 10
    s, ends = np.round(q @ lib.T, topk.DIGITS), [*starts[1:], 20]
    want = [(i, a + int(s[i, a:b].argmax())) for i in range(50) for a, b in zip(starts, ends, strict=True)]
    assert [(i, j) for r, c, _ in parts for i, j in zip(r, c, strict=True)] == want


def test_dense_blocks_equal_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, f"s{i}", f"g{i % 7}", [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(90)]
    lib = spark.createDataFrame(rows, "query_ix long, spec_id string, comp_id string, vec array<double>")
    facts = lambda: ([sorted(map(tuple, f(lib.select("query_ix", "vec"), lib.drop("query_ix"), *k).collect())) for f, k in ((topk.dense, (9,)), (topk.dense_best, ()))])
    want = facts()
    monkeypatch.setattr(topk, "PAIRS", 0)
    assert facts() == want
    for block in (20, 9):  # groups that fit a block, and groups that don't
        monkeypatch.setattr(topk, "BLOCK", block)
        assert facts() == want


@pytest.mark.parametrize("block", [topk.GROUP_BLOCK, 4])
def test_pairs_of_groups_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_BLOCK", block)
    monkeypatch.setattr(topk, "AT_ONCE", 100)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        x = rng.integers(0, 3, 6) * (i > 1)  # two empty ones
        rows.append((f"s{i}", None if i == 39 else int(i > 9), [float(v) for v in x], [int(j) for j in np.flatnonzero(x)], [float(v) for v in x[x > 0]]))
    df = spark.createDataFrame(rows, "id string, g int, x array<double>, bits array<bigint>, vals array<double>")
    want = {}
    for a in rows:
        for b in rows:
            if a[1] is not None and a[1] == b[1] and a[0] < b[0]:
                low, high = np.minimum(a[2], b[2]).sum(), np.maximum(a[2], b[2]).sum()
                want[a[0], b[0]] = low / high if high else None
    got = lambda df: {(r.a, r.b): r.score for r in df.collect()}
    assert got(topk.tanimoto_of_groups(df, "g", "id")) == pytest.approx(want)
    assert got(topk.dense_tanimoto_of_groups(df, "g", "id", "x")) == pytest.approx(want)
    full = {k: 1.0 if v is None else v for k, v in want.items()}
    assert got(topk.dense_tanimoto_of_groups(df, "g", "id", "x", manhattan=True)) == pytest.approx(full)


def test_copies_are_scored_once(spark, monkeypatch):
    met, own = [], topk.sparse_scores
    monkeypatch.setattr(topk, "sparse_scores", lambda q, lib, *a: met.append((q.count(), lib.count())) or own(q, lib, *a))
    rows = [(f"s{i:03}", [j, 9] if i % 2 else [9, j], [1.0, 2.0] if i % 2 else [2.0, 1.0]) for i in range(60) for j in [i // 2 % 3]]  # three fingerprints, bits in either order
    df = spark.createDataFrame(rows, "comp_id string, bits array<bigint>, vals array<double>")
    got = topk.scan(df.withColumnRenamed("comp_id", "query_ix"), df, 4).collect()
    assert met == [(3, 12)]
    want = {(f"s{i:03}", k + 1): f"s{j:03}" for i in range(60) for k, j in enumerate(sorted((j for j in range(60) if j // 2 % 3 == i // 2 % 3))[:4])}
    assert {(r.query_ix, r["rank"]): r.comp_id for r in got} == want and len(got) == 240


@pytest.mark.parametrize("broadcast", [topk.BROADCAST, 0])
def test_sums_equal_pairs(spark, broadcast, monkeypatch):
    for name, n in (("QUERY_BITS", 20), ("LIBRARY_BITS", 30), ("AT_ONCE", 100)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(9)
    rows = [(f"s{i}", [int(j) for j in np.flatnonzero(x)], [float(v) for v in x[x > 0]]) for i, x in enumerate(rng.integers(0, 2, (30, 9)))]
    df = spark.createDataFrame(rows, "comp_id string, bits array<bigint>, vals array<double>").where("size(bits) > 0")
    q = df.withColumnRenamed("comp_id", "query_ix")
    own = topk.sparse_scores(q, df, "query_ix", "comp_id").groupBy("query_ix").agg(F.sum("tanimoto").alias("total"), F.sum(F.col("tanimoto") ** 2).alias("squares"))
    facts = lambda df: {r.query_ix: pytest.approx((r.total, r.squares)) for r in df.collect()}
    assert {r.query_ix: (r.total, r.squares) for r in topk.tanimoto_sums(q, df, broadcast=broadcast).collect()} == facts(own)
    assert topk.tanimoto_pairs(q, df, broadcast=broadcast).count() == topk.sparse_scores(q, df, "query_ix", "comp_id").count()


def test_streamed_blocks_equal_broadcast(spark, monkeypatch):
    """Ties, a zero vector, chunks of the library and a query id with two vectors."""
    rng = np.random.default_rng(11)
    rows = [(i, f"s{i * 37 % 90}", [float(x) for x in rng.integers(-1, 2, 3) * (i != 5)]) for i in range(90)]
    lib = spark.createDataFrame(rows, "query_ix long, spec_id string, vec array<double>")
    twice = lib.select("query_ix", "vec").union(lib.where("query_ix = 7").select(F.lit(8).alias("query_ix"), "vec"))
    facts = lambda q: sorted(map(tuple, topk.dense(q, lib.drop("query_ix"), 9).collect()))
    want = [facts(q) for q in (lib.select("query_ix", "vec"), twice)]
    monkeypatch.setattr(topk, "PAIRS", 0)
    monkeypatch.setattr(topk, "AT_ONCE", 100)
    for block, met, sliced in ((20, 16, 50), (20, 1, 5)):
        for name, n in (("BLOCK", block), ("MET", met), ("SLICE", sliced)):
            monkeypatch.setattr(topk, name, n)
        assert [facts(q) for q in (lib.select("query_ix", "vec"), twice)] == want


def test_partial_answers_are_one_a_query(spark, monkeypatch):
    """Blocks of a search used to answer with k rows a query each, seven times the result at 1 GB."""
    monkeypatch.setattr(topk, "PAIRS", 0)
    monkeypatch.setattr(topk, "BLOCK", 10)
    met, own = [], topk.ranked
    monkeypatch.setattr(topk, "ranked", lambda scored, *a: met.append(scored.count()) or own(scored, *a))
    df = spark.createDataFrame([(i, f"s{i}", [float(i % 7), 1.0]) for i in range(40)], "query_ix long, spec_id string, vec array<double>")
    assert topk.dense(df.select("query_ix", "vec"), df.drop("query_ix"), 5).count() == 200
    assert all(n <= 200 for n in met)


def test_requested_ids_need_no_fingerprints(spark, tmp_path, monkeypatch):
    """Its library has the embeddings alone; it used to pack the whole of lineitem, too."""
    from ionquarry.plans import library_queries

    def refuse(*_):
        raise AssertionError("lineitem is no table of this query")

    monkeypatch.setattr(library_queries, "_numeric", refuse)
    made = "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from (select i + 1 as c_custkey, 'x' as c_name, 1 as c_nationkey, 1.0::double as c_acctbal, 'y' as c_mktsegment from range(40) t(i))"
    assert len(agree(spark, tmp_path, "knn_of_requested_ids", customer=made)) == 200


def test_index_scales_vectors_as_it_deals_them(spark):
    from ionquarry.operators import index

    rows = spark.createDataFrame([(f"s{i}", [3.0 * (i % 3), 4.0, 0.0] if i else [0.0] * 3) for i in range(12)], "spec_id string, vec array<float>")
    built, middles = index.build(rows, cells=2)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and len(middles) == 2
    want = {f"s{i}": np.array([3.0 * (i % 3), 4.0, 0.0]) / np.hypot(3.0 * (i % 3), 4.0) if i else np.zeros(3) for i in range(12)}
    assert all(np.allclose(r.vec, want[r.spec_id]) for r in built.collect()) and built.count() == 12


def test_products_round_as_in_sql():
    """Of the products of roots of 1 to 50, eight lie on a half of the twelfth digit."""
    from ionquarry.operators import peaks

    rows = duckdb.sql("select sqrt(a::double) * sqrt(b::double), round(sqrt(a::double) * sqrt(b::double), 12) from range(1, 51) x(a), range(1, 51) y(b)").fetchall()
    raw, want = np.array(rows).T
    assert (np.round(raw, 12) != want).sum() == 8
    assert (peaks.rounded(raw, 12) == want).all() and (peaks.rounded(-raw, 12) == -want).all()


def test_analogues_in_small_blocks_equal_sql(spark, tmp_path, monkeypatch):
    for name, n in (("ASKED", 7), ("BLOCK", 20), ("MERGED", 60), ("LIBRARY_BITS", 2000), ("AT_ONCE", 500)):
        monkeypatch.setattr(topk, name, n)
    assert len(agree(spark, tmp_path, "analogue_search_topk")) > 100


def test_analogues_join_no_query_with_a_spectrum(spark, monkeypatch):
    """A query used to be joined with each spectrum of its neighbours; now it has a row per neighbour."""
    rng = np.random.default_rng(5)
    vecs = [(f"s{i}", f"C{i % 3}", int(i % 3), [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(vecs, "spec_id string, own string, j int, vec array<double>")
    asked = df.select(F.substr("spec_id", F.lit(2)).cast("long").alias("query_ix"), F.lit("C0").alias("own"), "vec")
    held = df.select(F.lit("C0").alias("own"), "j", "vec")
    met, own = [], topk._as_bytes
    monkeypatch.setattr(topk, "_as_bytes", lambda rows, key: met.append(rows.count()) or own(rows, key))
    got = {(r.query_ix, r.j): r.score for r in topk.best_of_pairs(asked, held, "own", "j").collect()}
    x = np.array([v[3] for v in vecs])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    assert met == [60, 60] and got == pytest.approx({(i, j): s[i, j::3].max() for i in range(60) for j in range(3)})


def test_parts_are_encoded_as_lines(monkeypatch):
    from ionquarry.llm import tokens

    class Counting:
        def __init__(self, library):
            self.library, self.met = library, 0

        def encode_batch_fast(self, texts, **kw):
            self.met += len(texts)
            return self.library.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(tokens, "JOINED", 7)
    rng = np.random.default_rng(12)
    pieces = ["ab", "Don't", "\n", "\n\n", "\t", " ", "  ", "\r\n", " ", "　", "\x1c", "\x85", "12345", "!?", "你好", "\U0001f600", "é", "<|endoftext|>", "", "​", "á"]
    texts = ["".join(pieces[i] + " " * int(rng.integers(0, 2)) for i in rng.integers(0, len(pieces), 12)) for _ in range(3000)] + ["", " ", "\n", None]
    code = tokens.Encoder()
    want = code._whole([t or "" for t in texts])
    assert code.line is not None and code.encode(texts) == want
    code = tokens.Encoder()
    code.library = Counting(code.library)
    words = [f"word{i}x{i * i}" for i in range(500)]
    assert code.encode([" ".join(words)]) == tokens.Encoder()._whole([" ".join(words)]) and code.library.met < 100


def test_another_generator_is_not_taken_for_it(spark):
    """The report of the tests: after another library's generator, none of fingerprint_backfill_counts failed."""
    from ionquarry.plans.library_queries import Letters
    from ionquarry.plugins import compute_fingerprints

    class Kind:
        def fingerprint(self, smiles, inchi):
            return {7: 1.0}

    df = spark.range(160).repartition(8).selectExpr("cast(id as string) as comp_id", "concat('x', id) as smiles", "cast(null as string) as inchi")
    assert compute_fingerprints(df, Kind).where("failed").count() == 0
    assert compute_fingerprints(df, Letters).where("failed").count() == 16


def test_groups_are_chosen_where_rows_are_found(spark, tmp_path, monkeypatch):
    """All 40 rows of a query used to leave the search, to be joined with their compounds and sorted twice."""
    plan = entry.queries()["compounds_by_spectra_distinct"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan
    for name, n in (("BLOCK", 90), ("HELD", 120), ("AT_ONCE", 3000), ("SLICE", 400)):
        monkeypatch.setattr(topk, name, n)
    source = f"'{DATA}/embeddings.parquet'"
    copies = f"select vec_id, case when vec_id % 3 = 0 then (select embedding from {source} where vec_id = 0) else embedding end as embedding, label from {source}"
    assert len(agree(spark, tmp_path, "compounds_by_spectra_distinct", embeddings=copies)) == 2500


@pytest.mark.parametrize("kind", ["float", "double"])
def test_best_groups_equal_brute_force(spark, kind, monkeypatch):
    """Rows with no group, with several, with one twice, with null for a group; ties, a zero vector; one chunk, several, a query id with two vectors."""
    rng = np.random.default_rng(12)
    x = rng.integers(-1, 2, (90, 3)).astype(float)
    x[5] = 0
    ids = [f"s{i * 37 % 90:02}" for i in range(90)]
    lib = spark.createDataFrame([(i, ids[i], x[i].tolist()) for i in range(90)], f"query_ix long, spec_id string, vec array<{kind}>")
    own = [(ids[i], f"g{j % 7}" if j % 5 else None) for i in range(90) for j in range(i, i + i % 4)]
    maps = spark.createDataFrame(own + own[:9] + [("absent", "g1")], "spec_id string, comp_id string")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def want(asked):
        for q, rows in asked.items():
            near = sorted((-round(float(u[a] @ u[b]), 10) + 0.0, ids[b]) for a in rows for b in range(90))[:12]
            best = {}
            for s, i in near:
                for g in {g for j, g in own if j == i}:
                    best.setdefault(g, (s, i))
            top = sorted(best.values())[:4]
            yield q, [(i, -s + 0.0) for s, i in top], {(g, *v) for g, v in best.items()}

    def check(queries, asked):
        found = topk.dense_distinct(queries, lib.drop("query_ix"), maps, 12, 4).collect()
        for q, top, groups in want(asked):
            own = sorted((r for r in found if r.query_ix == q), key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, len(top) + 1)) and [(r.spec_id, pytest.approx(r.score)) for r in own] == top
            assert len({r.comp_id for r in own}) == len(own) and {(r.comp_id, r.spec_id) for r in own} <= {(g, i) for g, _, i in groups}

    queries, alone = lib.select("query_ix", "vec"), {i: [i] for i in range(90)}
    monkeypatch.setattr(topk, "HELD", 25)
    monkeypatch.setattr(topk, "SLICE", 50)
    for block in (100, 20):
        monkeypatch.setattr(topk, "BLOCK", block)
        check(queries, alone)
    monkeypatch.setattr(topk, "MET", 2)
    check(queries, alone)  # five blocks of queries, which the library passes whole
    check(queries.where("query_ix < 10"), {i: [i] for i in range(10)})  # one, which meets three chunks
    check(queries.union(lib.where("query_ix = 7").select(F.lit(8).alias("query_ix"), "vec")), alone | {8: [8, 7]})
    assert topk.dense_distinct(queries.where("false"), lib.drop("query_ix"), maps, 12, 4).columns == ["query_ix", "rank", "comp_id", "spec_id", "score"]


def test_queries_that_are_read_from_files_are_not_written_again(spark):
    """They were copied to the shared folder first, which starts processes for the modes of files."""
    before = len(storage.MADE)
    entry.queries()["compounds_by_spectra_distinct"](spark, str(DATA))
    assert len(storage.MADE) == before
    read = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    made = [read.withColumn("x", F.rand()), read.distinct(), read.mapInArrow(lambda batches: batches, read.schema), read.withColumn("x", F.udf(lambda x: len(x), "int")("embedding")), spark.createDataFrame([(1,)], "a int")]
    for n, df in enumerate(made, 1):
        assert storage.settled(df, "test").count() == df.count() and len(storage.MADE) == before + n
