"""A folder of Parquet tables with a manifest that says which files of each count.

A table is replaced by writing a new version and then a new manifest, which has
the next number and appears in one step: readers take the highest number, so they
see the old or the new state, a job that dies in between changes nothing, and of two
writers at once the second fails.  :meth:`TableStore.vacuum` deletes what no
manifest names any more.

Keyed tables take small changes as deltas, which a read folds in; after ``MOST_DELTAS``
of them the table is written anew.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from copy import deepcopy
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema as s
from ..operators import writes
from ..storage import create_text, names, read_text, remove

FORMAT_VERSION = 1
SCHEMAS: dict[str, StructType] = {
    "spectra": s.SPECTRA, "compounds": s.COMPOUNDS, "compounds_all": s.COMPOUNDS, "spec_to_comp": s.SPEC_TO_COMP,
    "embeddings": s.EMBEDDINGS, "merged_spectra": s.MERGED_SPECTRA, "merged_embeddings": s.MERGED_EMBEDDINGS,
}
#: How deltas are folded in: key, operator.
FOLDED = {"compounds": ("comp_id", writes.upsert), "compounds_all": ("comp_id", writes.upsert), "spec_to_comp": ("spec_id", writes.replace_by_key)}
MOST_DELTAS = 8
KEPT_MANIFESTS = 2
_MANIFEST = re.compile(r"manifest-(\d{9})\.json")


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    return [int(m[1]) for n in names(spark, folder) if (m := _MANIFEST.fullmatch(n))]


class TableStore:
    def __init__(self, spark: SparkSession, folder: str, manifest: dict, number: int = 0):
        self.spark, self.folder, self.manifest, self.number = spark, folder.rstrip("/"), manifest, number
        self._open = False

    @classmethod
    def create(cls, spark: SparkSession, folder: str, **extra) -> TableStore:
        """An empty store; one that is in the folder already is replaced."""
        store = cls(spark, folder, {"format_version": FORMAT_VERSION, "tables": {}, **extra}, max(_manifests(spark, folder), default=0))
        store._save()
        return store

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TableStore:
        found = _manifests(spark, folder)
        if not found:
            raise FileNotFoundError(f"no manifest in {folder}")
        manifest = json.loads(read_text(spark, cls._path(folder, found[-1])))
        if manifest.get("format_version") != FORMAT_VERSION:
            raise ValueError(f"format {manifest.get('format_version')} is not {FORMAT_VERSION}")
        return cls(spark, folder, manifest, found[-1])

    @staticmethod
    def _path(folder: str, number: int) -> str:
        return f"{folder.rstrip('/')}/manifest-{number:09d}.json"

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Changes of several tables that appear together, or not at all if the block fails."""
        before, outer = deepcopy(self.manifest), self._open
        self._open = True
        try:
            yield
        except BaseException:
            self.manifest = before
            raise
        finally:
            self._open = outer
        self._save()

    def _save(self) -> None:
        if self._open:
            return
        if not create_text(self.spark, self._path(self.folder, self.number + 1), json.dumps(self.manifest, indent=1, sort_keys=True)):
            raise RuntimeError(f"another writer has changed {self.folder}; load it again")
        self.number += 1

    def vacuum(self) -> int:
        """Delete the manifests but the last few, and the files that none of these names; how many were deleted."""
        numbers = _manifests(self.spark, self.folder)
        used, gone = set(), 0
        for n in numbers[-KEPT_MANIFESTS:]:
            held = json.loads(read_text(self.spark, self._path(self.folder, n)))
            used |= {p for part in ("tables", "deltas") for paths in held.get(part, {}).values() for p in paths}
        old = [f"{t}/{p}" for t in names(self.spark, self.folder) if not _MANIFEST.fullmatch(t) for p in names(self.spark, f"{self.folder}/{t}") if f"{t}/{p}" not in used]
        for path in [*old, *(self._path("", n)[1:] for n in numbers[:-KEPT_MANIFESTS])]:
            remove(self.spark, f"{self.folder}/{path}")
            gone += 1
        return gone

    def settings(self, name: str, default: dict | None = None) -> dict:
        """Stored settings win over the default."""
        return self.manifest.get("settings", {}).get(name) or default or {}

    def set_settings(self, name: str, values: dict) -> None:
        self.manifest.setdefault("settings", {})[name] = values
        self._save()

    def has(self, name: str) -> bool:
        return name in self.manifest["tables"] or name in self.manifest.get("deltas", {})

    def read(self, name: str) -> DataFrame:
        """The table, or an empty one of its schema if it was never written."""
        if name not in self.manifest["tables"] and name not in SCHEMAS:
            raise KeyError(f"no table {name}")
        if name in self.manifest["tables"]:
            base = self.spark.read.parquet(*[f"{self.folder}/{p}" for p in self.manifest["tables"][name]])
        else:
            base = self.spark.createDataFrame([], SCHEMAS[name])
        deltas = self.manifest.get("deltas", {}).get(name)
        if not deltas:
            return base
        key, fold = FOLDED[name]
        parts = [self.spark.read.parquet(f"{self.folder}/{p}").withColumn("pos", F.lit(i)) for i, p in enumerate(deltas)]
        return fold(base, reduce(DataFrame.unionByName, parts), key, "pos").select(*base.columns)

    def _write(self, name: str, df: DataFrame, sort: list[str]) -> str:
        path = f"{name}/{uuid.uuid4().hex[:12]}"
        have = [c for c in sort if c in df.columns]
        (df.sortWithinPartitions(*have) if have else df).write.parquet(f"{self.folder}/{path}")
        return path

    def replace(self, name: str, df: DataFrame, sort: list[str] = ()) -> DataFrame:
        """``sort``: columns whose min/max statistics should prune reads."""
        self.manifest["tables"][name] = [self._write(name, df, list(sort))]
        self.manifest.get("deltas", {}).pop(name, None)
        self._save()
        return self.read(name)

    def append(self, name: str, df: DataFrame, sort: list[str] = ()) -> DataFrame:
        self.manifest["tables"].setdefault(name, []).append(self._write(name, df, list(sort)))
        self._save()
        return self.read(name)

    def change(self, name: str, rows: DataFrame, sort: list[str] = ()) -> None:
        """Put a few rows, unique by key, into a keyed table without writing it anew."""
        full = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]
        self.manifest.setdefault("deltas", {}).setdefault(name, []).append(self._write(name, rows.select(*full).coalesce(1), []))
        self._save()
        if len(self.manifest["deltas"][name]) >= MOST_DELTAS:
            self.replace(name, self.read(name), sort)

    def drop(self, name: str) -> None:
        self.manifest["tables"].pop(name, None)
        self.manifest.get("deltas", {}).pop(name, None)
        self._save()

    def register(self) -> list[str]:
        """Temp views of all tables, for SQL."""
        every = [*{**SCHEMAS, **self.manifest["tables"]}]
        for n in every:
            self.read(n).createOrReplaceTempView(n)
        return every
