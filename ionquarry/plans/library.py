"""Build a library, load it, query it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions.fingerprints import exploded, from_dense
from ..functions.keys import strip_where
from ..operators import aggregate, index, lookup, merging, topk, writes
from ..plugins import compute_embeddings, compute_fingerprints, external, structure_counts, without_fingerprint
from ..schema import COMPOUNDS, KEY_LENGTH, METADATA_FIELDS, SPECTRA
from ..settings import FingerprintSettings, MergeSettings
from ..sources import compounds as compound_files
from ..sources import mgf
from ..sources import spectra as spectra_files_
from ..sources.tables import TableStore
from ..storage import written

#: Commands that only tell something, and plans that write though they aren't commands before analysis (class names).
TELLING, WRITING = ("Describe", "Show", "Explain"), ("Insert", "Compound")


def reads_only(spark: SparkSession, query: str) -> bool:
    """Whether the parsed plan of a statement, nested plans included, neither writes nor changes anything."""
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    command = loader.loadClass("org.apache.spark.sql.catalyst.plans.logical.Command")
    statement = loader.loadClass("org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    waiting = [spark._jsparkSession.sessionState().sqlParser().parsePlan(query)]
    while waiting:
        plan = waiting.pop()
        name = plan.getClass().getSimpleName()
        if name.startswith(WRITING) or ((command.isInstance(plan) or statement.isInstance(plan)) and not name.startswith(TELLING)):
            return False
        for below in (plan.children(), plan.innerChildren()):
            at = below.iterator()
            while at.hasNext():
                child = at.next()
                if hasattr(child, "innerChildren"):
                    waiting.append(child)
    return True


def analogue_search(
    queries: DataFrame, embeddings: DataFrame, mapping: DataFrame, bits: DataFrame, target: DataFrame, k_compounds: int = 10, k_neighbours: int = 10
) -> DataFrame:
    """(query_ix, rank, comp_id, score, weighted_average_score).

    ``queries(query_ix, vec)``, ``embeddings(spec_id, vec)``, ``mapping(spec_id, comp_id)``;
    ``bits`` and ``target``, (comp_id, bit, value) or packed, are searched for neighbours and for analogues.

    1. the best library spectrum of each query, and its compound;
    2. that compound's ``k_neighbours`` nearest compounds;
    3. each neighbour's best spectrum by cosine to the query: its score;
    4. the neighbours' fingerprints averaged with those scores as weights;
    5. a search of the result in ``target``.
    Queries that share a compound share its neighbours, so 3. is a matrix product for each such
    group, and averages are made where they are compared: what moves is a few weights a query.
    Queries whose compound has no fingerprint, or whose weights sum to 0 or less, give no rows.
    """
    top = topk.dense(queries, embeddings.join(mapping.select("spec_id"), "spec_id", "left_semi"), 1).join(mapping, "spec_id").select("query_ix", "comp_id")
    top, bits = written(top, "top"), topk.packed(bits, "comp_id")
    # Many queries share a compound: each is looked for once.
    asked = bits.join(top.select("comp_id").distinct(), "comp_id", "left_semi").withColumnRenamed("comp_id", "own")
    near = written(topk.sparse(asked, bits, k_neighbours, "own").select("own", F.col("rank").alias("j"), "comp_id"), "neighbours")
    top = top.withColumnRenamed("comp_id", "own").join(near.select("own").distinct(), "own", "left_semi")
    asking = top.join(queries.select("query_ix", "vec"), "query_ix")
    spectra = near.join(mapping, "comp_id").join(embeddings.select("spec_id", "vec"), "spec_id").select("own", "j", "vec")
    scores = written(topk.best_of_pairs(asking, spectra, "own", "j").select("query_ix", "own", "j", F.round("score", topk.DIGITS).alias("s")), "scores")
    total = scores.groupBy("query_ix", "own").agg(
        aggregate.weighted_average_score(F.col("s")).alias("weighted_average_score"), F.sum("s").alias("total"), F.collect_list(F.struct("j", "s")).alias("w")
    ).where("total > 0")
    weights = total.select("query_ix", "own", F.col("w.j").alias("js"), F.transform("w", lambda w: w["s"] / F.col("total")).alias("ws"))
    parts = near.join(bits, "comp_id").select("own", "j", "bits", "vals")
    found = topk.merged_sparse(weights, parts, target, k_compounds)
    return found.join(total.select("query_ix", "weighted_average_score"), "query_ix").select("query_ix", "rank", "comp_id", "score", "weighted_average_score")


class Library:
    """A library in a folder: its tables and the queries on them."""

    def __init__(self, store: TableStore, load_model: Callable | None = None, load_generator: Callable | None = None, process: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.store, self.spark = store, store.spark
        self.load_model, self.load_generator, self.process = load_model, load_generator, process
        self.settings = MergeSettings.of(store.settings("merging"))
        self.fingerprints = FingerprintSettings(**store.settings("fingerprints"))
        self._index: index.NeighbourIndex | None = None
        self._replaced: dict[str, DataFrame | None] = {}
        self.counts: dict = {}
        ship(self.spark)

    # Tables and settings.
    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def sql(self, query: str) -> DataFrame:
        """A query over the tables by name; anything but a query raises ``ValueError``."""
        if not reads_only(self.spark, query):
            raise ValueError("only queries can be run here")
        self.store.register()
        return self.spark.sql(query)

    def where(self, name: str, condition: str) -> DataFrame:
        return self.table(name).where(strip_where(condition))

    def set_fingerprint_settings(self, **values) -> None:
        """Refused once a fingerprint exists."""
        has = self.table("compounds").where("size(fp_bits) > 0 or size(fp_dense) > 0")
        if not has.isEmpty():
            raise RuntimeError("fingerprints exist; their settings can't be changed")
        self.fingerprints = FingerprintSettings(**{**asdict(self.fingerprints), **values})
        self.store.set_settings("fingerprints", self.fingerprints.to_dict())

    # Ingest.
    def add_spectra(self, spectra: DataFrame) -> dict:
        """Insert or ignore; ``requested`` rows and those that are ``new``."""
        spectra = written(spectra, "spectra")
        old = self.table("spectra")
        new = writes.absent_rows(old, spectra, "spec_id", "pos")
        before = old.count()
        after = self.store.append("spectra", new.select(*old.columns), sort=["inchikey", "precursor_mz"]).count()
        return {"requested": spectra.count(), "new": after - before}

    def map_compounds(self, create_missing: bool = True) -> dict:
        """Map annotated spectra to compounds by key, and add compounds that aren't known."""
        spectra = self.table("spectra").withColumn("pos", F.col("spec_id"))
        pairs = writes.mapping_rows(spectra)
        good = pairs.where("accepted").select("spec_id", "comp_id").withColumn("pos", F.col("spec_id"))
        mapped = self.store.replace("spec_to_comp", writes.links(self.table("spec_to_comp"), good), sort=["comp_id"])
        out = {"mapped": mapped.count(), "rejected": pairs.where("not accepted").count(), "new_compounds": 0}
        if create_missing:
            known = self.table("compounds")
            fresh = writes.missing_compounds(spectra, known)
            out["new_compounds"] = fresh.count()
            self.upsert_compounds(fresh)
        return out

    def link_many(self, pairs: list[tuple[str, str]]) -> None:
        """Put (spec_id, comp_id) pairs into the map, all or none; the last pair of a spectrum wins."""
        bad = [c for _, c in pairs if c is None or len(c) != KEY_LENGTH]
        if bad:
            raise ValueError(f"not 14-character keys: {bad[:3]}")
        last = {str(s): c for s, c in pairs}
        self.store.change("spec_to_comp", self.spark.createDataFrame([*last.items()], "spec_id string, comp_id string"), sort=["comp_id"])

    def link(self, spec_id: str, comp_id: str) -> None:
        self.link_many([(spec_id, comp_id)])

    def upsert_many(self, rows: list[dict]) -> list[str]:
        """Put compounds in by their full key, all or none; their comp_ids.  A missing or short key raises ``ValueError``."""
        ids = []
        for r in rows:
            key = (r.get("inchikey") or "").strip().upper()
            ids.append(key.split("-")[0][:KEY_LENGTH])
            if len(ids[-1]) != KEY_LENGTH:
                raise ValueError(f"no compound key in {r.get('inchikey')!r}")
        fields = [f.name for f in COMPOUNDS if f.name != "comp_id"]
        merged: dict[str, dict] = {}
        for c, r in zip(ids, rows, strict=True):
            merged.setdefault(c, {}).update({f: r[f] for f in fields if r.get(f) is not None and not (isinstance(r[f], (list, tuple)) and not r[f])})
        values = [(c, *[r.get(f) for f in fields]) for c, r in merged.items()]
        schema = "comp_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in COMPOUNDS if f.name != "comp_id")
        self.store.change("compounds", self.spark.createDataFrame(values, schema), sort=["comp_id"])
        return ids

    def upsert_compound(self, **row) -> str:
        return self.upsert_many([row])[0]

    def upsert_compounds(self, rows: DataFrame, pos: str | None = None) -> None:
        old = self.table("compounds")
        self.store.replace("compounds", writes.upsert(old, rows, "comp_id", pos), sort=["comp_id"])

    def overwrite_compounds(self, frame: DataFrame, mapper: dict | None = None, name: str = "compounds_all") -> dict:
        stats = writes.overwrite_stats(frame, mapper).first().asDict()
        new = writes.overwrite_compounds(frame, mapper)
        schema = self.table(name).schema
        full = [F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        self.store.replace(name, new.select(*full), sort=["comp_id"])
        return stats

    def compute_missing_embeddings(self, only_missing: bool = True) -> int:
        """How many embeddings were computed; ``only_missing=False`` replaces those that exist."""
        if self.load_model is None:
            raise RuntimeError("no embedding model is set")
        if not only_missing:
            return self.store.replace("embeddings", compute_embeddings(self.process(self.table("spectra")), self.load_model, self.settings.normalize_sum)).count()
        have = self.table("embeddings")
        before = have.count()
        todo = self.process(lookup.without(self.table("spectra"), have))
        return self.store.append("embeddings", compute_embeddings(todo, self.load_model, self.settings.normalize_sum)).count() - before

    def compute_missing_fingerprints(self, name: str = "compounds") -> dict:
        if self.load_generator is None:
            raise RuntimeError("no fingerprint generator is set")
        all_ = self.table(name)
        todo = without_fingerprint(all_)
        made = compute_fingerprints(todo, self.load_generator, self.fingerprints)
        skipped = structure_counts(all_).first().skipped
        new = written(made, "fingerprints")
        n = new.agg(F.count("*").alias("attempted"), F.coalesce(F.sum(F.col("failed").cast("int")), F.lit(0)).alias("failed")).first()
        self.store.replace(name, writes.upsert(all_, new.drop("failed"), "comp_id"), sort=["comp_id"])
        return {"attempted": n["attempted"], "updated": n["attempted"] - n["failed"], "failed": n["failed"], "skipped": skipped}

    def merge_mapped_spectra(self) -> int:
        """Consensus spectra of mapped compounds that have none yet."""
        done = self.table("merged_spectra")
        before = done.count()
        settings = MergeSettings.of({**self.settings.to_dict(), "min_frac": 0.5, "metadata_policy": "vote"})
        merged = merging.merge_mapped(self.table("spectra").withColumn("pos", F.col("spec_id")), self.table("spec_to_comp"), done, settings)
        full = [F.col(f.name) if f.name in merged.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in done.schema]
        return self.store.append("merged_spectra", merged.select(*full)).count() - before

    # Indexes: derived tables that searches read instead of the source tables once they are there.
    def build_embedding_index(self, condition: str | None = None, cells: int | None = None) -> int:
        """Cells of unit vectors around centroids; how many vectors.  No rows or mixed lengths raise ``ValueError``."""
        rows = self.table("embeddings")
        built, middles = index.build(rows.where(strip_where(condition)) if condition else rows, cells=cells)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        listed = [(i, m.tolist()) for i, m in enumerate(middles)]
        with self.store.transaction():
            n = self.store.replace("index_embeddings", built.repartitionByRange(parts, "cell", "spec_id"), sort=["cell", "spec_id"]).count()
            self.store.replace("index_embeddings_centroids", self.spark.createDataFrame(listed, "cell int, vec array<double>"))
        return n

    def embedding_index(self, probes: int | None = None) -> index.VectorIndex:
        """The stored index; it must have been built."""
        middles = self._ready("index_embeddings_centroids").orderBy("cell").collect()  # at most MOST_CELLS rows
        return index.VectorIndex(self.table("index_embeddings"), np.array([m.vec for m in middles]), probes=probes)

    def set_embedding_index(self, found: index.NeighbourIndex | None) -> None:
        """The index that spectrum searches ask from now on; None: exact search of the stored vectors."""
        self._index = found

    def build_fingerprint_index(self, name: str = "compounds") -> int:
        """Fingerprints packed by compound, with their L1 norms; how many.  Negative values raise."""
        rows = self.packed(name)
        bad = F.raise_error(F.lit("fingerprint values must not be negative")).cast("array<double>")
        rows = rows.withColumn("vals", F.when(~F.exists("vals", lambda v: v < 0), F.col("vals")).otherwise(bad))
        l1 = F.aggregate("vals", F.lit(0.0), lambda a, v: a + v)
        return self.store.replace(f"index_{name}", rows.withColumn("l1", l1), sort=["comp_id"]).count()

    def fingerprint_norms(self, name: str = "compounds") -> DataFrame:
        """(comp_id, l1) from the stored index."""
        return self._ready(f"index_{name}").select("comp_id", "l1")

    def set_fingerprint_index(self, name: str, rows: DataFrame | None) -> None:
        """Fingerprints, (comp_id, bit, value) or packed, that searches read from now on in place of a table's; None: the table's."""
        self._replaced[name] = rows if rows is None else topk.packed(rows, "comp_id")

    def _vectors(self) -> DataFrame:
        return self.table("index_embeddings") if self.store.has("index_embeddings") else self._ready("embeddings")

    def _nearest(self, queries: DataFrame, k: int) -> DataFrame:
        return self._index.query(queries, k) if self._index is not None else topk.dense(queries, self._vectors(), k)

    def _postings(self, name: str) -> DataFrame:
        if self._replaced.get(name) is not None:
            return self._replaced[name]
        return self.table(f"index_{name}").select("comp_id", "bits", "vals") if self.store.has(f"index_{name}") else self.packed(name)

    # Lookups.
    def ids(self) -> DataFrame:
        return self.table("spectra").select("spec_id")

    def compound_ids(self) -> DataFrame:
        return self.table("compounds").select("comp_id").orderBy("comp_id")

    def all_fingerprints(self) -> DataFrame:
        """By compound key, compounds without a fingerprint included."""
        return self.table("compounds").select("comp_id", "fp_bits", "fp_values", "fp_dense").orderBy("comp_id")

    def all_mappings(self) -> DataFrame:
        return self.table("spec_to_comp")

    def compound(self, comp_id: str) -> dict | None:
        return lookup.compound(self.table("compounds"), comp_id)

    def fingerprint(self, comp_id: str) -> dict | list | None:
        """A compound's dense fingerprint, else bit -> value, else None."""
        row = self.fingerprints_by_ids([comp_id]).first()
        if row.fp_dense:
            return list(row.fp_dense)
        return dict(zip(row.fp_bits, row.fp_values or [1.0] * len(row.fp_bits), strict=True)) if row.fp_bits else None

    def unique_compounds(self, more: DataFrame | None = None, key: str = "inchikey14") -> DataFrame:
        """(inchikey14, n_spectra, inchikey), and the columns of a user's table joined on ``key``."""
        found = aggregate.unique_compounds(self.table("spectra"))
        return found if more is None else lookup.with_external(found, more, "inchikey14", key)

    def _ask(self, ids: Sequence[str], key: str = "spec_id") -> DataFrame:
        return lookup.request(self.spark, ids, key)

    def spectra_by_spec_ids(self, ids: Sequence[str]) -> DataFrame:
        return lookup.spectra_by_ids(self.table("spectra"), self._ask(ids))

    def fragments_by_spec_ids(self, ids: Sequence[str], single: bool = False) -> DataFrame:
        return lookup.fragments_by_ids(self.table("spectra"), self._ask(ids), single)

    def metadata_by_spec_ids(self, ids: Sequence[str]) -> DataFrame:
        return lookup.metadata_by_ids(self.table("spectra"), self._ask(ids))

    def embeddings_by_spec_ids(self, ids: Sequence[str] | None = None, normalized: bool = True) -> DataFrame:
        return lookup.embeddings_by_ids(self.table("embeddings"), None if ids is None else self._ask(ids), normalized)

    def compounds_by_ids(self, ids: Sequence[str]) -> DataFrame:
        return lookup.compounds_by_ids(self.table("compounds"), self._ask(ids, "comp_id"))

    def fingerprints_by_ids(self, ids: Sequence[str]) -> DataFrame:
        return lookup.fingerprints_by_ids(self.table("compounds"), self._ask(ids, "comp_id"))

    def spec_ids_by_comp_ids(self, ids: Sequence[str]) -> DataFrame:
        return lookup.spectra_of_comp_ids(self.table("spec_to_comp"), self._ask(ids, "comp_id"))

    def metadata_by_comp_ids(self, ids: Sequence[str]) -> DataFrame:
        return lookup.metadata_by_comp_ids(self.table("spec_to_comp"), self.table("spectra"), self._ask(ids, "comp_id"))

    def spectra_by_comp_ids(self, ids: Sequence[str]) -> DataFrame:
        return self.spec_ids_by_comp_ids(ids).join(self.table("spectra"), "spec_id")

    def embeddings_by_comp_ids(self, ids: Sequence[str], normalized: bool = True) -> DataFrame:
        own = self.spec_ids_by_comp_ids(ids).select(F.lit(0).alias("pos"), "spec_id")
        return lookup.embeddings_by_ids(self.table("embeddings"), own, normalized)

    # Searches.
    def packed(self, name: str = "compounds") -> DataFrame:
        """(comp_id, bits, vals) of the compounds that have a fingerprint, of either layout; without values each bit counts 1."""
        rows = self.table(name)
        ones = F.transform("fp_bits", lambda _: F.lit(1.0).cast("float"))
        values = F.when(F.size("fp_values") > 0, F.col("fp_values")).otherwise(ones)
        both = F.when(F.size("fp_bits") > 0, F.struct(F.col("fp_bits").alias("bits"), values.alias("values"))).when(F.size("fp_dense") > 0, from_dense(F.col("fp_dense")))
        return rows.select("comp_id", both.alias("f")).where("f is not null").select("comp_id", "f.bits", F.col("f.values").cast("array<double>").alias("vals"))

    def bits(self, name: str = "compounds") -> DataFrame:
        """(comp_id, bit, value), from the stored index if there is one."""
        return topk.unpacked(self._postings(name), "comp_id")

    def _ready(self, name: str) -> DataFrame:
        if not self.store.has(name):
            raise RuntimeError(f"the library has no {name}")
        return self.table(name)

    def _embedded(self, spectra: DataFrame) -> DataFrame:
        """(query_ix, vec) of spectra with ``pos``; a column ``vec`` is taken as it is."""
        if "vec" in spectra.columns:
            return spectra.select(F.col("pos").cast("long").alias("query_ix"), "vec")
        if self.load_model is None:
            raise RuntimeError("no embedding model is set")
        rows = self.process(spectra).withColumn("spec_id", F.col("pos").cast("string"))
        made = compute_embeddings(rows, self.load_model, self.settings.normalize_sum)
        return made.select(F.col("spec_id").cast("long").alias("query_ix"), "vec")

    def query_spectra_by_spectra(self, spectra: DataFrame, k_spectra: int = 10) -> DataFrame:
        return self._nearest(self._embedded(spectra), k_spectra)

    def query_by_spec_ids(self, ids: Sequence[str], k: int = 10) -> DataFrame:
        """(query_ix, query_spec_id, rank, spec_id, score); ``query_ix`` is the place in the request."""
        asked = self._ask(ids).withColumnsRenamed({"pos": "query_ix", "spec_id": "query_spec_id"})
        stored = self._ready("embeddings")
        queries = asked.join(stored.select(F.col("spec_id").alias("query_spec_id"), "vec"), "query_spec_id")
        return self._nearest(queries.select("query_ix", "vec"), k).join(asked, "query_ix").select("query_ix", "query_spec_id", "rank", "spec_id", "score")

    def query_compounds_by_spectra(self, spectra: DataFrame, k_spectra: int = 100, k_compounds: int = 10, distinct_compounds: bool = False) -> DataFrame:
        if k_compounds > k_spectra:
            raise ValueError("k_compounds must not exceed k_spectra")
        hits = self.query_spectra_by_spectra(spectra, k_spectra)
        if distinct_compounds:
            hits = hits.join(self.table("spec_to_comp"), "spec_id")
            hits = aggregate.best_per_group(hits.drop("rank"), ["query_ix", "comp_id"], "score", "spec_id")
        best = topk.ranked(hits.drop("rank"), k_compounds, "query_ix", "spec_id")
        return best.join(self.table("spectra").select("spec_id", *[f for f in METADATA_FIELDS if f in SPECTRA.names]), "spec_id")

    def query_compounds_by_compounds(self, structures: DataFrame, k_compounds: int = 10) -> DataFrame:
        """(query_ix, rank, comp_id, score) for rows (pos, fp_bits, fp_values) or (pos, smiles | inchi), not both of the latter."""
        self._ready("compounds")
        if "fp_bits" not in structures.columns:
            if ("smiles" in structures.columns) == ("inchi" in structures.columns):
                raise ValueError("give either smiles or inchi")
            if self.load_generator is None:
                raise RuntimeError("no fingerprint generator is set")
            rows = structures.withColumn("comp_id", F.col("pos").cast("string"))
            for c in ("smiles", "inchi"):
                rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
            made = compute_fingerprints(rows, self.load_generator, self.fingerprints)
            both = made.select(F.col("comp_id").cast("long").alias("pos"), F.when(F.size("fp_bits") > 0, F.struct(F.col("fp_bits").alias("bits"), F.col("fp_values").alias("values"))).otherwise(from_dense(F.col("fp_dense"))).alias("f"))
            structures = both.where("f is not null").select("pos", F.col("f.bits").alias("fp_bits"), F.col("f.values").alias("fp_values"))
        asked = exploded(structures.withColumn("query_ix", F.col("pos").cast("long")), "query_ix")
        return topk.sparse(asked, self._postings("compounds"), k_compounds)

    def analogue_search(self, spectra: DataFrame, k_compounds: int = 10) -> DataFrame:
        own = self._postings("compounds")
        wide = self._postings("compounds_all") if self.store.has("compounds_all") else own
        target = own if wide.isEmpty() else wide
        return analogue_search(self._embedded(spectra), self._vectors(), self.table("spec_to_comp"), own, target, k_compounds)

    def compound_graph(self, k: int = 25) -> DataFrame:
        return topk.knn_graph(self._postings("compounds"), k)

    def compound_layout(self, k: int = 25, most: int = 200_000, **settings) -> DataFrame:
        """(comp_id, x, y): a 2-D layout of the neighbour graph by the package umap, on the driver.

        More than ``most`` compounds raise ``ValueError``; without the package a ``RuntimeError`` says so.
        """
        umap = external("umap", "the layout")
        n = self.table("compounds").count()
        if n > most:
            raise ValueError(f"{n} compounds are more than {most}")
        edges = self.compound_graph(k).toPandas()
        names = sorted(edges["node"].unique())
        place = {c: i for i, c in enumerate(names)}
        near, far = np.zeros((len(names), k), dtype=np.int64), np.ones((len(names), k))
        for node, rank, neighbour, distance in edges[["node", "rank", "neighbour", "distance"]].itertuples(index=False):
            near[place[node], rank - 1], far[place[node], rank - 1] = place[neighbour], distance
        xy = umap.UMAP(n_neighbors=k, precomputed_knn=(near, far, None), **settings).fit_transform(np.zeros((len(names), 1)))
        return self.spark.createDataFrame([(c, float(x), float(y)) for c, (x, y) in zip(names, xy, strict=True)], "comp_id string, x double, y double")

    def close(self) -> None:
        for n in self.store.manifest["tables"]:
            self.spark.catalog.dropTempView(n)


def create_library(
    spark: SparkSession, spectra_files: list[str], folder: str, compound_file: str | None = None, merge: bool = True,
    settings: dict | None = None, load_model: Callable | None = None, load_generator: Callable | None = None, fingerprints: dict | None = None,
    create_missing: bool = True,
) -> Library:
    """Read spectra, merge near-identical ones, store and map them; embeddings and fingerprints where a plug-in is given.

    ``settings`` and ``fingerprints`` override the defaults of ``MergeSettings`` and
    ``FingerprintSettings``; ``counts`` of the result says what was added.
    """
    ship(spark)
    chosen, kind = MergeSettings.of(settings), FingerprintSettings(**(fingerprints or {}))
    store = TableStore.create(spark, folder, settings={"merging": chosen.to_dict(), "fingerprints": kind.to_dict()})
    library = Library(store, load_model, load_generator)
    spectra = written(spectra_files_.read(spark, spectra_files), "read")
    if merge:
        merged = merging.merge_spectra(spectra, chosen)
        merged = merged.withColumns({"spec_id": mgf.spectrum_id(F.col("peaks")), "n_peaks": F.size("peaks"), "pos": F.col("cluster_id")})
        rest = spectra if chosen.merge_unannotated else spectra.where("inchikey is null or trim(inchikey) = ''")
        names = ["pos", *SPECTRA.names]
        spectra = merged.select(*names) if chosen.merge_unannotated else merged.select(*names).unionByName(rest.select(*names))
    with store.transaction():
        library.counts = library.add_spectra(spectra) | library.map_compounds(create_missing)
    if load_generator:
        library.counts["fingerprints"] = library.compute_missing_fingerprints()
    if compound_file:
        library.counts["compounds_all"] = library.overwrite_compounds(compound_files.read(spark, compound_file))
    if load_model:
        library.counts["embeddings"] = library.compute_missing_embeddings()
    return library


def load_library(spark: SparkSession, folder: str, load_model: Callable | None = None, load_generator: Callable | None = None) -> Library:
    """An existing library; ``FileNotFoundError`` without a manifest.  Its settings are those it was built with."""
    return Library(TableStore.load(spark, folder), load_model, load_generator)
