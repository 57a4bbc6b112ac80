"""Incremental ingest as a stream (an extension): each micro-batch is an insert-or-ignore into a library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.writes import absent_rows
from ..sources.tables import TableStore


def ingest_spectra(stream: DataFrame, store: TableStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append spectra whose id the library lacks.

    A batch that is run again after a failure finds its own rows and adds nothing.
    """

    def put(batch: DataFrame, _: int) -> None:
        rows = batch if "pos" in batch.columns else batch.withColumn("pos", F.monotonically_increasing_id())
        known = store.read("spectra")
        new = absent_rows(known, rows, "spec_id", "pos").select(*known.columns)
        if not new.isEmpty():
            store.append("spectra", new, sort=["inchikey", "precursor_mz"])

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
