"""Token ids as Arrow files of equal-length sequences.

A data set is a folder of shards.  ``shard-*.arrow`` is an Arrow IPC file (the
stream format between a magic string and a footer that lists the batches) with

    input_ids       fixed_size_list<uint16 or uint32>[sequence]
    attention_mask  fixed_size_list<bool>[sequence], bits in the file

in batches of ``BATCH`` sequences, so sequence i is row i % BATCH of batch
i // BATCH and its ids can be used straight from the mapped file, without a copy.
Only a shard's last sequence is padded, so every mask is ones and then zeros: a
reader gives it, a byte a token, as a view of one such ramp, without a copy either.
``shard-*.docs.arrow`` lists the shard's documents: doc_id, start in the shard's
ids, n_tokens.  Ids run on without a gap from document to document; only a
shard's last sequence is padded (mask 0).

Documents are range-partitioned by doc_id, so shards are in ascending order and
a document's place in the whole is its shard's first place plus its start.  A
shard's name holds the task attempt; the manifest (one row a shard) names the
files that count, so a retried or lost task leaves only files nobody reads.

Files are opened through ``pyarrow.fs`` (local, HDFS, S3, GCS, ABFS URIs).

Defined cases: a null or empty text is the end id alone; a null doc_id comes
first; rows that share a doc_id follow each other in the order of their texts;
other columns are ignored; an empty table gives a data set without documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import open_fs, scratch, shuffle_parts, slices, trimmed, written
from .tokens import TOKENIZER, encoder

SEQUENCE, BATCH, END_ID = 2048, 256, 0
#: Documents that are listed at once.
DOCS = 8192
MANIFEST = "shard int, path string, docs_path string, n_sequences long, n_tokens long, n_docs long"


class ShardWriter:
    """One shard: ids go in a document at a time and out in batches of equal-length sequences."""

    def __init__(self, uri: str, name: str, dtype: np.dtype, sequence: int = SEQUENCE, batch: int = BATCH):
        self.fs, folder = open_fs(uri)
        self.uri, self.name, self.folder = uri, name, folder
        self.sequence, self.batch, self.dtype = sequence, batch, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("input_ids", pa.list_(kind, sequence)), ("attention_mask", pa.list_(pa.bool_(), sequence))])
        self.sink = self.fs.open_output_stream(f"{folder}/{name}.arrow")
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.waiting, self.held = [], 0
        self.docs: list[tuple] = []  # not yet written
        self.docs_schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens")])
        self.docs_sink = self.fs.open_output_stream(f"{folder}/{name}.docs.arrow")
        self.docs_file = pa.ipc.new_file(self.docs_sink, self.docs_schema)
        self.n_tokens = self.n_sequences = self.n_docs = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        count = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.n_tokens, count))
        if len(self.docs) == DOCS:
            self._list()
        self.n_tokens += count
        self.waiting.append(ids)
        self.held += count
        if self.held >= self.sequence * self.batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.waiting), dtype=self.dtype)
        block = self.sequence * self.batch
        full = len(flat) if last else len(flat) - len(flat) % block
        for at in range(0, full, block):
            part = flat[at : min(at + block, full)]
            rows = -(-len(part) // self.sequence)
            ids = np.zeros(rows * self.sequence, dtype=self.dtype)
            ids[: len(part)] = part
            mask = np.arange(rows * self.sequence) < len(part)
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
            self.n_sequences += rows
        self.waiting = [flat[full:].tobytes()]
        self.held = len(flat) - full

    def _list(self) -> None:
        """Write the list of documents so far."""
        self.docs_file.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)], schema=self.docs_schema))
        self.n_docs += len(self.docs)
        self.docs = []

    def close(self) -> tuple:
        self._flush(True)
        if self.docs:
            self._list()
        for end in (self.file, self.sink, self.docs_file, self.docs_sink):
            end.close()
        base = f"{self.uri}/{self.name}"
        return f"{base}.arrow", f"{base}.docs.arrow", self.n_sequences, self.n_tokens, self.n_docs


class Shard:
    """Random access to one shard file."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("input_ids").type.list_size
        self.batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self._at, self._now = -1, None
        # Of the last sequence, how many ids; of all before, every one.
        last = self.file.num_record_batches - 1
        self.n_tokens = last * self.sequence * self.batch + (pc.sum(self.file.get_batch(last).column("attention_mask").flatten()).as_py() if last >= 0 else 0)
        self.ramp = np.repeat(np.array([1, 0], dtype=np.uint8), self.sequence)
        self.ramp.flags.writeable = False

    def _ids(self, i: int) -> np.ndarray:
        if i != self._at:
            self._at, self._now = i, self.file.get_batch(i)
        return self._now.column("input_ids").flatten().to_numpy(zero_copy_only=True)

    def sequence_at(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence i: views of the file and of the ramp."""
        part = slice((i % self.batch) * self.sequence, (i % self.batch + 1) * self.sequence)
        padded = max(0, (i + 1) * self.sequence - self.n_tokens)
        return self._ids(i // self.batch)[part], self.ramp[padded : padded + self.sequence]

    def ids(self, start: int, count: int) -> np.ndarray:
        block = self.sequence * self.batch
        parts = []
        while count > 0:
            i, at = divmod(start, block)
            part = self._ids(i)[at : at + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, np.uint16)])


@dataclass
class Dataset:
    """A written data set: its folder and its manifest (shard, path, ..., first: place of its first id)."""

    uri: str
    manifest: DataFrame


def write(
    docs: DataFrame, uri: str | None = None, tokenizer: str = TOKENIZER, end_id: int = END_ID, sequence: int = SEQUENCE,
    text: str = "text", doc_id: str = "doc_id",
) -> Dataset:
    spark = docs.sparkSession
    uri = uri or scratch(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, code, out = TaskContext.get(), encoder(tokenizer), None
        end = np.array([end_id], dtype=code.dtype).tobytes()
        for b in batches:
            for part in slices(b, 1):
                for i, ids in zip(part.column(0).to_pylist(), code.encode(part.column(1)), strict=True):
                    if out is None:
                        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
                        out = ShardWriter(uri, name, code.dtype, sequence)
                    out.add(i, ids + end)
        if out is not None:
            path, docs_path, n_sequences, n_tokens, n_docs = out.close()
            row = {"shard": task.partitionId(), "path": path, "docs_path": docs_path, "n_sequences": n_sequences}
            yield pa.RecordBatch.from_pylist(
                [row | {"n_tokens": n_tokens, "n_docs": n_docs}],
                schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs_path", pa.string()), *((c, pa.int64()) for c in ("n_sequences", "n_tokens", "n_docs"))]),
            )

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    dealt = rows.repartitionByRange(shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(dealt.mapInArrow(trimmed(run), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return Dataset(uri, manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))))


def read(data: Dataset) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files; ``ids`` is a string of 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, docs_path, first in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(path)
                fs, at = open_fs(docs_path)
                with fs.open_input_file(at) as source:
                    listed = pa.ipc.open_file(source)
                    parts = [b for i in range(listed.num_record_batches) for b in pa.Table.from_batches([listed.get_batch(i)]).to_batches(max_chunksize=512)]
                for part in parts:
                    starts, counts = part.column(1).to_numpy(), part.column(2).to_numpy()
                    ids = [shard.ids(s, n).astype("<u4").tobytes() for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(starts + first), part.column(2), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    spark: SparkSession = data.manifest.sparkSession
    shards = data.manifest.select("path", "docs_path", "first").repartition(shuffle_parts(spark))
    return shards.mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids binary")
