"""Tables in storage that every executor sees, used to cut lineage and to freeze results."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
#: Scratch tables and folders made so far, in order.
MADE: list[str] = []


def _fs(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def shared_root(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, as a full URI.

    The setting is read from the session; only where it is unset and driver and
    executors are one process (tests, a laptop) is a folder chosen here, else a
    ``RuntimeError`` asks for it.  The tree is removed when Python exits.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="ionquarry-")
            spark.sparkContext.setCheckpointDir(base)
        fs, path = _fs(spark, f"{base.rstrip('/')}/ionquarry-{app}")
        fs.mkdirs(path)
        full = fs.makeQualified(path).toString()
        if full.startswith("file:/") and not full.startswith("file://"):
            full = "file://" + full.removeprefix("file:")
        _ROOTS[app] = full
        atexit.register(_forget, spark, full)
    return _ROOTS[app]


def _forget(spark: SparkSession, uri: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, uri)


def remove(spark: SparkSession, uri: str) -> None:
    fs, path = _fs(spark, uri)
    fs.delete(path, True)


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _fs(spark, uri)
    return fs.exists(path)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, path = _fs(spark, source)
    fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(target))


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder URI for files that executors write themselves."""
    uri = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    fs, path = _fs(spark, uri)
    fs.mkdirs(path)
    MADE.append(uri)
    return uri


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder.

    Unlike a cached or locally checkpointed frame it survives lost executors,
    and it freezes whatever depends on how the rows were dealt to tasks.
    """
    spark = df.sparkSession
    uri = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    MADE.append(uri)
    df.write.parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    out._ionquarry_uri = uri
    return out


def settled(df: DataFrame, label: str) -> DataFrame:
    """The frame itself if it only picks and computes columns and rows of files, which read alike again; else :func:`written`."""
    node = df._jdf.queryExecution().optimizedPlan()
    plain = node.deterministic()
    while plain and node.children().nonEmpty():
        plain, node = node.nodeName() in ("Project", "Filter"), node.children().head()
    plain = plain and node.nodeName() == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation"
    return df if plain else written(df, label)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame from :func:`written` once nothing reads it."""
    remove(df.sparkSession, df._ionquarry_uri)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files that no live frame refers to."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def read_text(spark: SparkSession, uri: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(uri, wholetext=True).collect())


def create_text(spark: SparkSession, uri: str, text: str) -> bool:
    """A new small file, which appears in one step; False if there is one of that name."""
    fs, path = _fs(spark, f"{uri}.{uuid.uuid4().hex[:12]}")
    out = fs.create(path, False)
    out.write(bytearray(text.encode()))
    out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(uri)
    done = not fs.exists(target) and fs.rename(path, target)
    if not done:
        fs.delete(path, False)
    return done


def names(spark: SparkSession, uri: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    fs, path = _fs(spark, uri)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
