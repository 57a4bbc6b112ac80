"""Places for an embedding model and a fingerprint generator.

A model is a function that gives a loaded object with
``embed(list of (mz, intensity, metadata)) -> 2-D array``; a generator one with
``fingerprint(smiles, inchi) -> dict bit -> count, 1-D array or None``.  Each is loaded
once in a Python worker; a loader that takes an argument gets the settings.  None
ships here but :class:`Morgan`, which needs the package rdkit.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.fingerprints import prepared, scaled_dense, stored
from .functions.keys import present
from .functions.vectors import l2_normalized, sum_normalized
from .settings import FingerprintSettings

_LOADED: dict[str, object] = {}


def loaded(load: Callable, key: str, *given):
    """The object of a loader, one for each key and worker; ``given`` is passed on if the loader takes an argument."""
    if key not in _LOADED:
        try:
            takes = any(p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in inspect.signature(load).parameters.values())
        except ValueError:  # built in
            takes = False
        _LOADED[key] = load(*given) if takes else load()
    return _LOADED[key]


def marked(load: Callable, key: str) -> str:
    """``key`` for this loader alone: workers outlive a query, and another library's plug-in may have been loaded in them."""
    return f"{key} {hashlib.sha256(cloudpickle.dumps(load)).hexdigest()}"


def external(package: str, what: str):
    """A loader that says which package is missing."""
    try:
        return importlib.import_module(package)
    except ModuleNotFoundError as missing:
        raise RuntimeError(f"{what} needs the package {package}, which isn't installed; pass a loader of your own") from missing


def compute_embeddings(spectra: DataFrame, load: Callable, normalize_spectrum: bool = True, normalize_embedding: bool = True, key: str = "model") -> DataFrame:
    """(spec_id, d, vec) of each spectrum, in Arrow batches."""
    peaks = sum_normalized(F.col("peaks")) if normalize_spectrum else F.col("peaks")
    meta = [c for c in spectra.columns if c not in ("spec_id", "peaks", "pos")]
    key = marked(load, key)
    rows = spectra.select("spec_id", peaks.alias("peaks"), F.struct(*meta).alias("meta") if meta else F.lit(None).alias("meta"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(load, key)
        for b in batches:
            if not b.num_rows:
                continue
            given = [
                (np.array([p["mz"] for p in ps or []]), np.array([p["intensity"] for p in ps or []]), m or {})
                for ps, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            ]
            x = np.asarray(model.embed(given), dtype=np.float32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(list(x), pa.list_(pa.float32()))], names=["spec_id", "d", "vec"]
            )

    out = rows.mapInArrow(run, "spec_id string, d int, vec array<float>")
    return out.withColumn("vec", l2_normalized(F.col("vec")).cast("array<float>")) if normalize_embedding else out


class Morgan:
    """Morgan fingerprints by the package rdkit: counts by bit, unfolded, or an array of ``n_bits``."""

    def __init__(self, settings: FingerprintSettings):
        self.settings, self.chem = settings, external("rdkit.Chem", "the Morgan fingerprint")
        kind = external("rdkit.Chem.rdFingerprintGenerator", "the Morgan fingerprint")
        self.made = kind.GetMorganGenerator(radius=settings.radius, fpSize=settings.n_bits)

    def molecule(self, smiles: str | None, inchi: str | None):
        """Strictly read, else with the checks of valences left out; None if that fails too."""
        chem = self.chem
        if not smiles:
            found = chem.MolFromInchi(inchi)
            smiles = chem.MolToSmiles(found) if found is not None else None
        if not smiles:
            return None
        strict = chem.MolFromSmiles(smiles)
        if strict is not None:
            return strict
        loose = chem.MolFromSmiles(smiles, sanitize=False)
        if loose is None:
            return None
        flags = chem.SanitizeFlags
        steps = ("FINDRADICALS", "KEKULIZE", "SETAROMATICITY", "SETCONJUGATION", "SETHYBRIDIZATION", "SYMMRINGS")  # fixed values
        loose.UpdatePropertyCache(strict=False)
        chem.SanitizeMol(loose, sum(int(getattr(flags, f"SANITIZE_{s}")) for s in steps), catchErrors=True)
        return loose

    def fingerprint(self, smiles: str | None, inchi: str | None):
        try:
            found = self.molecule(smiles, inchi)
        except RuntimeError as bad:  # rdkit's own errors
            raise ValueError(str(bad)) from bad
        if found is None:
            return None
        if self.settings.sparse:
            return dict(self.made.GetSparseCountFingerprint(found).GetNonzeroElements())
        return self.made.GetCountFingerprintAsNumPy(found) if self.settings.count else self.made.GetFingerprintAsNumPy(found)


def compute_fingerprints(compounds: DataFrame, load: Callable, settings: FingerprintSettings = FingerprintSettings(), key: str = "generator") -> DataFrame:
    """(comp_id, fp_bits, fp_values, fp_dense, failed): smiles first, InChI only where that is blank.

    Counts are scaled and weighted as the settings say; without ``count`` a bit's
    value is 1.  A structure that can't be read gives null fingerprints; rows stay on their key.
    """
    key = marked(load, f"{key} {settings}")
    rows = compounds.select(
        "comp_id", F.when(present(F.col("smiles")), F.col("smiles")).alias("smiles"),
        F.when(~F.coalesce(present(F.col("smiles")), F.lit(False)) & present(F.col("inchi")), F.col("inchi")).alias("inchi"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generator = loaded(load, key, settings)
        for b in batches:
            found = []
            for smiles, inchi in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    found.append(generator.fingerprint(smiles, inchi))
                except ValueError:
                    found.append(None)
            shown = [None if f is None else sorted((int(k), float(v)) for k, v in f.items()) if settings.sparse else [float(v) for v in f] for f in found]
            kind = pa.map_(pa.int64(), pa.float64()) if settings.sparse else pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shown, kind), pa.array([f is None for f in found])], names=["comp_id", "raw", "failed"])

    out = rows.mapInArrow(run, f"comp_id string, raw {'map<bigint,double>' if settings.sparse else 'array<double>'}, failed boolean")
    none = lambda kind: F.lit(None).cast(kind)
    raw = F.col("raw")
    if settings.sparse:
        ready = prepared(raw if settings.count else F.transform_values(raw, lambda k, v: F.lit(1.0)), settings.scaling, settings.weights)
        cells = [F.when(raw.isNotNull(), stored(True, ready))["bits"].alias("fp_bits"), F.when(raw.isNotNull(), ready["values"]).alias("fp_values"), none("array<float>").alias("fp_dense")]
    else:
        cells = [none("array<bigint>").alias("fp_bits"), none("array<float>").alias("fp_values"), stored(False, scaled_dense(raw, settings.scaling, settings.weights)).alias("fp_dense")]
    return out.select("comp_id", *cells, "failed")


def without_fingerprint(compounds: DataFrame) -> DataFrame:
    """Compounds that have a structure but no fingerprint."""
    none = (F.coalesce(F.size("fp_bits"), F.lit(0)) <= 0) & (F.coalesce(F.size("fp_dense"), F.lit(0)) <= 0)
    return compounds.where(none & F.coalesce(present(F.col("smiles")) | present(F.col("inchi")), F.lit(False)))


def structure_counts(compounds: DataFrame) -> DataFrame:
    """(with_smiles, inchi_only, skipped): what a generator reads of each compound."""
    smiles, inchi = (F.coalesce(present(F.col(c)), F.lit(False)) for c in ("smiles", "inchi"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return compounds.agg(n(smiles, "with_smiles"), n(~smiles & inchi, "inchi_only"), n(~smiles & ~inchi, "skipped"))
