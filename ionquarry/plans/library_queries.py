"""Queries that go through a stored :class:`Library`, its writers, its plug-ins and the file readers."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, fingerprints, keys, vectors
from ..operators import topk
from ..schema import EMBEDDINGS, PEAKS, SPECTRA
from ..settings import FingerprintSettings, MergeSettings
from ..sources import compounds as compound_files
from ..sources import mgf, msp
from ..sources.memory import spectra_frame
from ..sources.tables import SCHEMAS, TableStore
from ..storage import scratch
from .library import Library
from .queries import BLOCKS, DIGITS, IK14, KNN, LOOSE, TANI, _round, query
from .views import Views

_SHARED: dict[tuple, Library] = {}


class PeakCount:
    """A model that tells spectra apart by their number of peaks, modulo 4."""

    def embed(self, spectra):
        return np.eye(4, dtype=np.float32)[[len(mz) % 4 for mz, *_ in spectra]]


class Letters:
    """A generator that counts the letters of a structure; a final 7 can't be read."""

    def fingerprint(self, smiles, inchi):
        text = smiles or inchi
        if text.endswith("7"):
            raise ValueError(text)
        return {ord(c): text.count(c) for c in text}


def _full(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def _spectra(v: Views) -> DataFrame:
    peaks = v("v_peaks").groupBy("spec_id").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    rows = v("v_spectra").join(peaks, "spec_id", "left").withColumn("peaks", F.coalesce("peaks", F.array().cast(PEAKS)))
    return rows.withColumns({"n_peaks": F.size("peaks"), "inchi": F.lit(None).cast("string"), "name": F.col("smiles")}).select("pos", *SPECTRA.names)


def _fresh(v: Views, tables: dict[str, DataFrame], **plug_ins) -> Library:
    """A library in a folder of its own."""
    settings = {"merging": LOOSE.to_dict(), "fingerprints": FingerprintSettings().to_dict()}
    store = TableStore.create(v.spark, scratch(v.spark, "library"), settings=settings)
    for name, df in tables.items():
        store.replace(name, _full(df, name), sort=[SCHEMAS[name].names[0]])
    return Library(store, **plug_ins)


def _shared(v: Views, kind: str, make) -> Library:
    """One library of a kind for each folder and application, for queries that only read it."""
    key = (v.spark.sparkContext.applicationId, v.folder, kind)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def _spectral(v: Views) -> Library:
    """The spectra, their map and the compounds."""
    return _shared(v, "spectral", lambda: _fresh(v, {"spectra": _spectra(v), "spec_to_comp": v("v_spec_to_comp"), "compounds": v("v_compounds")}))


def _numeric(v: Views) -> Library:
    """The embeddings, their map and the fingerprints, both indexed."""

    def make() -> Library:
        e = v("v_embeddings").withColumn("d", F.size("vec"))
        fps = topk.packed(v("v_fp"), "comp_id").withColumnsRenamed({"bits": "fp_bits", "vals": "fp_values"})
        made = _fresh(v, {"embeddings": e, "spec_to_comp": v("v_emb_map"), "compounds": fps, "spectra": e})
        made.build_embedding_index()
        made.build_fingerprint_index()
        return made

    return _shared(v, "numeric", make)


def _indexed(v: Views) -> Library:
    """The embeddings, indexed."""

    def make() -> Library:
        made = _fresh(v, {"embeddings": v("v_embeddings").withColumn("d", F.size("vec"))})
        made.build_embedding_index()
        return made

    return _shared(v, "indexed", make)


# --- Searches ---------------------------------------------------------------------------------


@query(f"""with {KNN}, r as (select *, row_number() over (partition by query_ix order by score desc, spec_id) as rank from k)
select query_ix, cast(rank as integer) as rank, spec_id, round(score, 6) as score from r where rank <= 10""")
def knn_by_spec_ids(v):
    library = _shared(v, "vectors", lambda: _fresh(v, {"embeddings": v("v_embeddings").withColumn("d", F.size("vec"))}))
    return _round(library.query_spectra_by_spectra(v("v_embeddings").select("pos", "vec"), 10), "score")


@query(f"""with {KNN}, r as (select *, row_number() over (partition by query_ix order by score desc, spec_id) as rank from k),
a as (select c_custkey as query_ix, cast((c_custkey - c_custkey % 2) * 3 as varchar) as query_spec_id from customer)
select a.query_ix, a.query_spec_id, cast(rank as integer) as rank, spec_id, round(score, 6) as score
from a join r on cast(r.query_ix as varchar) = a.query_spec_id where rank <= 5""")
def knn_of_requested_ids(v):
    asked = v("v_request").select("pos", ((F.col("pos") - F.col("pos") % 2) * 3).cast("string").alias("spec_id"))
    return _round(_indexed(v).query_by_spec_ids(asked, 5), "score")


@query(f"""with {TANI}, r as (select *, row_number() over (partition by query_ix order by score desc, comp_id) as rank from s)
select cast(substr(query_ix, 2) as bigint) as query_ix, cast(rank as integer) as rank, comp_id, round(score, 6) as score from r where rank <= 4""")
def compounds_by_compounds(v):
    own = _numeric(v).all_fingerprints().select(F.substr("comp_id", F.lit(2)).cast("long").alias("pos"), "fp_bits", "fp_values")
    return _round(_numeric(v).query_compounds_by_compounds(own, 4), "score")


LETTERS = """t as (select comp_id, coalesce(smiles, inchi) as text from {0} where coalesce(smiles, inchi) is not null and right(coalesce(smiles, inchi), 1) <> '7'),
l as (select comp_id, unnest(string_split(text, '')) as c from t),
f as (select comp_id, cast(unicode(c) as bigint) as bit, cast(count(*) as double) as value from l group by 1, 2)"""


@query(f"""with {LETTERS.format("v_compounds")}, n as (select comp_id, sum(value) as l1 from f group by comp_id),
a as (select c_custkey as query_ix, upper(substr(md5(cast(c_custkey as varchar)), 1, 14)) as own from customer where c_custkey % 25 = 0),
s as (select a.query_ix, y.comp_id, sum(least(x.value, y.value)) as low from a join f x on a.own = x.comp_id join f y on x.bit = y.bit group by 1, 2),
z as (select s.query_ix, s.comp_id, round(low / (m.l1 + n.l1 - low), 10) as score from s join a on s.query_ix = a.query_ix join n m on a.own = m.comp_id join n on s.comp_id = n.comp_id),
r as (select *, row_number() over (partition by query_ix order by score desc, comp_id) as rank from z)
select query_ix, cast(rank as integer) as rank, comp_id, round(score, 6) as score from r where rank <= 3""")
def compounds_by_structures(v):
    library = _shared(v, "letters", lambda: _fresh(v, {"compounds": v("v_compounds")}, load_generator=Letters))
    if library.bits().isEmpty():
        library.compute_missing_fingerprints()
    asked = v.spark.read.parquet(f"{v.folder}/customer.parquet").where("c_custkey % 25 = 0")
    return _round(library.query_compounds_by_compounds(asked.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("smiles")), 3), "score")


@query("select comp_id, sum(abs(value)) as l1 from v_fp group by comp_id")
def stored_norms(v):
    return _numeric(v).fingerprint_norms()


@query("select cast(vec_id as varchar) as spec_id, 1 + vec_id % 60 as c from embeddings where vec_id % 60 < 20")
def embeddings_of_compounds(v):
    asked = v.spark.range(20).select(F.col("id").alias("pos"), F.format_string("C%d", F.col("id") + 1).alias("comp_id"))
    found = _numeric(v).embeddings_by_comp_ids(asked)
    return found.select("spec_id", (F.col("spec_id").cast("long") % 60 + 1).alias("c"))


# --- Scans and lookups ------------------------------------------------------------------------


@query("select spec_id from v_spectra")
def library_spectrum_ids(v):
    return _spectral(v).ids()


@query("select comp_id from v_compounds")
def library_compound_ids(v):
    return _spectral(v).compound_ids()


@query("select comp_id, count(*) as n_bits, sum(value) as total from v_fp group by comp_id")
def library_fingerprints(v):
    return _numeric(v).all_fingerprints().select("comp_id", F.size("fp_bits").cast("long").alias("n_bits"), vectors.total(F.col("fp_values")).alias("total"))


@query("select spec_id, comp_id from v_spec_to_comp")
def library_mappings(v):
    return _spectral(v).all_mappings()


@query("""select s.spec_id, m.comp_id, s.precursor_mz, s.charge, p.n_peaks from v_spectra s join v_spec_to_comp m on s.spec_id = m.spec_id
left join (select spec_id, count(*) as n_peaks from v_peaks group by spec_id) p on s.spec_id = p.spec_id where m.comp_id in (select comp_id from v_request)""")
def library_spectra_of_compounds(v):
    found = _spectral(v).spectra_by_comp_ids(v("v_request"))
    return found.select("spec_id", "comp_id", "precursor_mz", "charge", F.nullif("n_peaks", F.lit(0)).cast("long").alias("n_peaks"))


@query("""select r.pos, s.spec_id, s.inchikey from v_request r join v_spectra s on r.spec_id = s.spec_id""")
def library_spectra_in_request_order(v):
    return _spectral(v).spectra_by_spec_ids(v("v_request")).select("pos", "spec_id", "inchikey")


@query("select comp_id, smiles from v_compounds where comp_id in (select comp_id from v_compounds order by comp_id limit 5)")
def library_compound(v):
    library = _spectral(v)
    some = [r.comp_id for r in library.compound_ids().limit(5).collect()]
    return v.spark.createDataFrame([(c, library.compound(c)["smiles"]) for c in some], "comp_id string, smiles string")


@query("""select ionmode, count(*) as n, round(avg(precursor_mz), 4) as mean_mz from v_spectra where precursor_mz > 1000 group by ionmode""")
def sql_over_tables(v):
    return _spectral(v).sql("with s as (select * from spectra where precursor_mz > 1000) select ionmode, count(*) as n, round(avg(precursor_mz), 4) as mean_mz from s group by ionmode")


@query("""select spec_id, precursor_mz from v_spectra where precursor_mz > 300000""")
def library_where(v):
    return _spectral(v).where("spectra", "WHERE precursor_mz > 300000").select("spec_id", "precursor_mz")


@query(f"""with u as (select {IK14.replace("inchikey", "k")} as inchikey14, count(*) as n_spectra from (select inchikey as k from v_spectra) group by 1)
select inchikey14, n_spectra from u where inchikey14 is not null""")
def library_unique_compounds(v):
    return _spectral(v).unique_compounds().select("inchikey14", "n_spectra")


@query("""select * from (values ('metadata_policy', 'concat'), ('min_frac', '0.25'), ('mz_tol', '0.01'), ('n_bits', '4096'), ('radius', '9'), ('fp_type', 'morgan'), ('sparse', 'True'), ('count', 'True')) t(name, value)""")
def default_settings(v):
    held = {**MergeSettings().to_dict(), **_spectral(v).fingerprints.to_dict()}
    names = ("metadata_policy", "min_frac", "mz_tol", "n_bits", "radius", "fp_type", "sparse", "count")
    return v.spark.createDataFrame([(n, str(held[n])) for n in names], "name string, value string")


# --- Writers ----------------------------------------------------------------------------------


@query("""select (select count(*) from v_spectra) as requested, (select count(*) from v_spectra where pos % 3 <> 0) as new, (select count(*) from v_spectra) as after""")
def add_spectra(v):
    rows = _spectra(v)
    library = _fresh(v, {"spectra": rows.where("pos % 3 = 0")})
    counts = library.add_spectra(rows)
    return v.spark.createDataFrame([(counts["requested"], counts["new"], library.ids().count())], "requested long, new long, after long")


@query("""with k as (select distinct left(inchikey, 14) as comp_id from v_spectra where inchikey is not null)
select (select count(*) from v_spectra where inchikey is not null) as mapped, cast(0 as bigint) as rejected, (select count(*) from k where comp_id not in (select comp_id from v_updates)) as new_compounds,
       (select count(*) from (select comp_id from k union select comp_id from v_updates)) as compounds""")
def map_compounds(v):
    library = _fresh(v, {"spectra": _spectra(v), "compounds": v("v_updates")})
    counts = library.map_compounds()
    row = (counts["mapped"], counts["rejected"], counts["new_compounds"], library.compound_ids().count())
    return v.spark.createDataFrame([row], "mapped long, rejected long, new_compounds long, compounds long")


def _key(n: int) -> str:
    return hashlib.md5(str(n).encode()).hexdigest()[:14].upper()


@query("""with n as (select c_custkey as i, upper(substr(md5(cast(c_custkey as varchar)), 1, 14)) as comp_id from customer where c_custkey < 40)
select c.comp_id, case when n.i % 3 = 0 then concat('one', cast(n.i as varchar)) when n.i is not null and n.i % 2 = 0 then concat('two', cast(n.i as varchar)) else c.smiles end as smiles,
       coalesce(case when n.i % 3 = 0 then concat('inchi', cast(n.i as varchar)) end, c.inchi) as inchi from v_compounds c left join n on c.comp_id = n.comp_id""")
def upsert_one_and_many(v):
    library = _fresh(v, {"compounds": v("v_compounds")})
    library.upsert_many([{"inchikey": f"{_key(i)}-X", "smiles": f"two{i}"} for i in range(0, 40, 2)])
    library.upsert_many([{"inchikey": f"{_key(i).lower()}-Y", "smiles": f"one{i}", "inchi": f"inchi{i}"} for i in range(3, 40, 3)])
    library.upsert_compound(inchikey=f"{_key(0)}-Y", smiles="one0", inchi="inchi0")
    return library.table("compounds").select("comp_id", "smiles", "inchi")


@query("""select spec_id, case when cast(spec_id as bigint) < 30 then upper(substr(md5('5'), 1, 14)) else comp_id end as comp_id from v_spec_to_comp
union all select cast(o_orderkey as varchar), upper(substr(md5('5'), 1, 14)) from orders where o_orderkey < 30 and o_custkey % 7 = 0""")
def link_one_and_many(v):
    library = _fresh(v, {"spec_to_comp": v("v_spec_to_comp")})
    library.link_many([(str(i), _key(4)) for i in range(30)] + [(str(i), _key(5)) for i in range(29)])
    library.link("29", _key(5))
    return library.all_mappings()


@query("""with p as (select spec_id, count(*) as n from v_peaks group by spec_id)
select s.spec_id, cast(coalesce(n, 0) % 4 as integer) as place from v_spectra s left join p on s.spec_id = p.spec_id""")
def embedding_backfill(v):
    rows, eye = _spectra(v), "transform(sequence(0, 3), i -> cast(i = n_peaks % 4 as float))"
    old = rows.where("pos % 2 = 0").select("spec_id", F.lit(4).alias("d"), F.expr(eye).alias("vec"))
    library = _fresh(v, {"spectra": rows, "embeddings": old}, load_model=PeakCount)
    library.compute_missing_embeddings()
    return library.table("embeddings").select("spec_id", (F.array_position("vec", F.lit(1.0).cast("float")) - 1).cast("int").alias("place"))


@query(f"with {LETTERS.format('v_updates')} select comp_id, bit, value from f")
def fingerprint_backfill(v):
    library = _fresh(v, {"compounds": v("v_updates")}, load_generator=Letters)
    library.compute_missing_fingerprints()
    return library.bits()


@query("""with t as (select coalesce(smiles, inchi) as text from v_updates)
select count(text) as attempted, count(case when right(text, 1) <> '7' then 1 end) as updated, count(case when right(text, 1) = '7' then 1 end) as failed, count(*) - count(text) as skipped from t""")
def fingerprint_backfill_counts(v):
    counts = _fresh(v, {"compounds": v("v_updates")}, load_generator=Letters).compute_missing_fingerprints()
    names = ("attempted", "updated", "failed", "skipped")
    return v.spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(f"""with recursive {BLOCKS.replace("a.pos < c.pos", "a.spec_id < c.spec_id")}, ed as (select sa as u, sb as v from sc join pr using (a, b) where score >= 0.3 union all select sb, sa from sc join pr using (a, b) where score >= 0.3),
nd as (select spec_id, comp_id from b), rc as (select spec_id as node, spec_id as root from nd union select ed.v, rc.root from rc join ed on rc.node = ed.u),
cl as (select node, min(root) as root from rc group by node)
select nd.comp_id, cl.root as first_id, count(*) as num_merged, string_agg(node, ',' order by node) as sources from cl join nd on cl.node = nd.spec_id group by 1, 2""")
def merged_spectra_of_library(v):
    rows = _spectra(v)
    library = _fresh(v, {"spectra": rows.where("n_peaks > 0").union(rows.where("n_peaks = 0")), "spec_to_comp": v("v_spec_to_comp")})
    library.merge_mapped_spectra()
    made = library.table("merged_spectra")
    return made.select("comp_id", F.col("source_spec_ids")[0].alias("first_id"), F.col("num_merged").cast("long"), F.array_join("source_spec_ids", ",").alias("sources"))


# --- Files, values and codecs -----------------------------------------------------------------


def _text_files(v: Views, rows: DataFrame, value: Column, suffix: str) -> str:
    """Records as text files in scratch storage."""
    folder = f"{scratch(v.spark, 'files')}/spectra.{suffix}"
    rows.select(value.alias("value")).write.text(folder)
    return folder


FILES = """select s.spec_id as name, s.precursor_mz, s.charge, p.n_peaks, p.total from v_spectra s
join (select spec_id, count(*) as n_peaks, sum(intensity) as total from v_peaks group by spec_id) p on s.spec_id = p.spec_id"""


def _file_facts(found: DataFrame) -> DataFrame:
    total = F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"])
    return found.select("name", "precursor_mz", "charge", F.col("n_peaks").cast("long").alias("n_peaks"), total.alias("total"))


@query(FILES)
def read_mgf(v):
    lines = F.array_join(F.transform("peaks", lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string"))), "\n")
    head = F.concat(F.lit("BEGIN IONS\nPEPMASS="), F.col("precursor_mz").cast("string"), F.lit(" 1000.0\nCOMPOUND_NAME="), F.col("spec_id"), F.lit("\nCHARGE="), F.coalesce("charge", F.lit("")), F.lit("\n"))
    folder = _text_files(v, _spectra(v).where("n_peaks > 0"), F.concat(head, lines, F.lit("\nEND IONS\n")), "mgf")
    return _file_facts(mgf.read(v.spark, folder))


@query(FILES)
def read_msp(v):
    lines = F.array_join(F.transform("peaks", lambda p: F.concat(p["mz"].cast("string"), F.lit("\t"), p["intensity"].cast("string"), F.lit(' "note"'))), "\n")
    head = F.concat(F.lit("Name: "), F.col("spec_id"), F.lit("\nPrecursorMZ: "), F.col("precursor_mz").cast("string"), F.lit("\nCharge: "), F.coalesce("charge", F.lit("")), F.lit("\nNum Peaks: "), F.col("n_peaks").cast("string"), F.lit("\n"))
    folder = _text_files(v, _spectra(v).where("n_peaks > 0"), F.concat(head, lines, F.lit("\n")), "msp")
    return _file_facts(msp.read(v.spark, folder))


@query("select comp_id, smiles, inchi from v_compounds")
def read_compound_file(v):
    path = f"{scratch(v.spark, 'files')}/compounds.csv"
    v("v_compounds").write.option("header", True).csv(path)
    return compound_files.read(v.spark, path).select("comp_id", "smiles", "inchi")


@query("select cast(r_regionkey as bigint) as pos, cast(r_regionkey + 1.5 as double) as precursor_mz, r_name as name, cast(2 as bigint) as n_peaks, cast(r_regionkey + 3 as double) as total from region")
def spectra_from_values(v):
    rows = v.spark.read.parquet(f"{v.folder}/region.parquet").orderBy("r_regionkey").collect()
    given = [{"mz": [2.0, 1.0], "intensities": [1.0, 2.0 + r.r_regionkey], "precursor_mz": str(r.r_regionkey + 1.5), "name": r.r_name} for r in rows]
    total = F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"])
    return spectra_frame(v.spark, given).select("pos", "precursor_mz", "name", F.col("n_peaks").cast("long").alias("n_peaks"), total.alias("total"))


@query("""select spec_id, len(vec) as n, round(list_sum(vec::double[]), 6) as total, cast(4 * len(vec) as bigint) as size from v_embeddings""")
def legacy_codecs(v):
    rows = v("v_embeddings").select("spec_id", codecs.floats_to_bytes(F.col("vec")).alias("blob"))
    back = rows.withColumn("back", codecs.npy_from_bytes(codecs.npy_to_bytes(codecs.floats_from_bytes(F.col("blob")))))
    return back.select("spec_id", F.size("back").cast("long").alias("n"), F.round(vectors.total(F.col("back")), DIGITS).alias("total"), F.octet_length("blob").cast("long").alias("size"))


@query("""with g as (select f.*, s_nationkey as grp from v_fp f join supplier on f.comp_id = concat('C', cast(s_suppkey as varchar))), n as (select comp_id, grp, sum(value) as l1 from g group by 1, 2),
m as (select a.comp_id as a, b.comp_id as b, sum(least(a.value, b.value)) as low from g a join g b on a.grp = b.grp and a.bit = b.bit and a.comp_id < b.comp_id group by 1, 2)
select x.comp_id as a, y.comp_id as b, round(coalesce(low, 0) / (x.l1 + y.l1 - coalesce(low, 0)), 6) as score from n x join n y on x.grp = y.grp and x.comp_id < y.comp_id left join m on m.a = x.comp_id and m.b = y.comp_id""")
def tanimoto_sparse_rows(v):
    rows = topk.packed(v("v_fp"), "comp_id").join(v("v_groups").select("comp_id", "grp"), "comp_id")
    return _round(topk.tanimoto_of_groups(rows, "grp", "comp_id"), "score")


@query("""select pos, case when pos % 4 = 1 then null else cast(pos as double) + 0.5 end as precursor_mz, case when pos % 3 = 0 then null else concat(' x', cast(pos as varchar)) end as ionmode,
case when pos % 5 = 0 then inchikey else coalesce(nullif(inchikey, ''), 'other') end as name from v_keys""")
def normalized_metadata(v):
    text = F.col("pos").cast("string")
    mz = F.when(F.col("pos") % 4 == 1, F.when(F.col("pos") % 8 == 1, "nan").otherwise("n/a")).otherwise(F.concat(F.lit(" "), text, F.lit(".5\t900")))
    params = {"pepmass": mz, "ionmode": F.when(F.col("pos") % 3 != 0, F.concat(F.lit(" x"), text)).otherwise("")}
    rows = v("v_keys").select("pos", "inchikey", F.map_from_arrays(F.array(*map(F.lit, params)), F.array(*params.values())).alias("m"))
    made = rows.select("pos", "inchikey", *keys.normalized_metadata(F.col("m"), ("precursor_mz", "ionmode"), mgf.ALIASES))
    own = F.when(F.col("pos") % 5 == 0, F.col("inchikey")).otherwise(keys.meta(F.create_map(F.lit("k"), keys.absent(F.col("inchikey"))), "k", "other"))
    return made.select("pos", "precursor_mz", "ionmode", own.alias("name"))


@query("""select comp_id, round(sum(ln(1 + value) * case when bit % 2 = 0 then 2.0 else 1.0 end), 1) as total from
(select comp_id, bit % 64 as bit, sum(value) as value from v_fp group by 1, 2) group by comp_id""")
def fp_scaled_dense(v):
    folded = v("v_fp").groupBy("comp_id", (F.col("bit") % 64).alias("bit")).agg(F.sum("value").alias("value"))
    maps = folded.groupBy("comp_id").agg(F.map_from_entries(F.collect_list(F.struct("bit", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0)))
    made = maps.select("comp_id", fingerprints.scaled_dense(dense, "log", [2.0 if i % 2 == 0 else 1.0 for i in range(64)]).alias("x"))
    return made.select("comp_id", F.round(vectors.total(F.col("x")), 1).alias("total"))


@query("select spec_id, cast(len(vec) as integer) as d from v_embeddings")
def embedding_table(v):
    return _numeric(v).table("embeddings").select(*[F.col(c) for c in EMBEDDINGS.names if c != "vec"])
