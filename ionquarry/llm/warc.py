"""Content-addressed WARC archive.

``archive`` splits pages into two tables: ``payloads`` (digest, payload), every
payload once under its SHA-256, and ``records`` (record_id, page_id, type,
exact header bytes, digest).  The digest of a payload is checked whenever its
bytes are read back.  ``reconstruct`` joins the tables to the exact bytes of each
original record.  ``write`` puts the records into WARC/1.1 files (a gzip member
per record), and ``read`` parses such files.

Of records with equal payloads of at least ``LEAST`` (1000) bytes the one with the largest
page_id is a ``response``; the others are ``revisit`` records without a payload
that refer to it.  Smaller payloads are all stored with their records.

Files are opened through ``pyarrow.fs``; the manifest, one row a file, names
those that count, so lost or repeated tasks leave only files nobody reads.

Defined cases: null html is an empty payload; a null page_id comes before all
others and reads back as null; repeated rows (equal page_id and payload) elect one
response by row; a null url, or one with control characters, is percent-encoded
(null: ``urn:page:`` and the id); other columns are ignored; an empty table
gives an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import open_fs, release_shuffles, scratch, shuffle_parts, trimmed, written
from ..operators.joins import joined_back

LEAST = 1000
#: The date that goes into records; pages carry none.
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LOW = -(2**63)


def _base32(hex_sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def _uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def header(record_id: str, page_id: int | None, url: str | None, size: int, sha1: str, refers: str | None) -> bytes:
    """The exact bytes before a record's payload: WARC header and, in a response, HTTP header."""
    http = HTTP % size
    lines = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{record_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Payload-Digest", _base32(sha1)),
        *([("WARC-Refers-To", f"<urn:uuid:{refers}>"), ("WARC-Profile", PROFILE)] if refers else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if refers else size))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + http


@dataclass
class Archive:
    """``records``: record_id, page_id, type, head, sha256, large; ``payloads``: sha256, payload.

    Payloads of ``least`` bytes and more are in ``large``, a table bucketed by
    digest: each has one response, so records join it without moving a payload.
    The others, in ``small``, may have any number.
    """

    records: DataFrame
    large: DataFrame
    small: DataFrame
    name: str  # of the large payloads' table in the catalog

    @property
    def payloads(self) -> DataFrame:
        return self.large.unionByName(self.small)

    def drop(self) -> None:
        """Take the table out of the catalog, once nothing reads the archive any more; its files go with the scratch folder."""
        self.records.sparkSession.sql(f"drop table if exists {self.name}")

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *error) -> None:
        self.drop()


def archive(pages: DataFrame, least: int = LEAST, page_id: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    spark = pages.sparkSession
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    keys = written(rows.select("page_id", "url", "sha256", "sha1", "size").withColumn("row", F.monotonically_increasing_id()), "pages")
    order = F.struct(F.coalesce("page_id", F.lit(LOW)).alias("p"), F.col("row").alias("row"))
    first = keys.where(F.col("size") >= least).groupBy("sha256").agg(F.max(order).alias("first"))
    told = joined_back(keys, first, "sha256", "left")
    # The id of a record: from its page, its payload and, among repeated rows, its number.
    uuid = lambda page, row: F.regexp_replace(
        F.left(F.sha2(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), F.col("sha256"), row.cast("string")), 256), F.lit(32)),
        "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5",
    )
    page_of = F.when(F.col("first.p") > LOW, F.col("first.p"))
    told = told.select(
        "page_id", "url", "sha256", "sha1", "size", uuid(F.col("page_id"), F.col("row")).alias("record_id"),
        F.when(F.col("first.row") != F.col("row"), uuid(page_of, F.col("first.row"))).alias("refers"),
    )

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, url, sha256, sha1, size, rid, refers = (b.column(i).to_pylist() for i in range(7))
            large = [n >= least for n in size]
            head = [header(*x) for x in zip(rid, page, url, size, sha1, refers, strict=True)]
            kind = ["revisit" if r else "response" for r in refers]
            yield pa.RecordBatch.from_arrays(
                [b.column(5), b.column(0), pa.array(kind), pa.array(head, pa.binary()), b.column(2), pa.array(large)],
                names=["record_id", "page_id", "type", "head", "sha256", "large"],
            )

    records = written(told.mapInArrow(trimmed(heads), "record_id string, page_id long, type string, head binary, sha256 string, large boolean"), "records")
    # Equal digests are equal payloads: the first of each is stored (partial aggregation drops the rest before the shuffle).
    once = lambda some: rows.where(some).groupBy("sha256").agg(F.first("payload").alias("payload"))
    name = f"ionquarry_payloads_{uuid4().hex[:12]}"
    large = once(F.col("size") >= least).write.bucketBy(shuffle_parts(spark), "sha256")
    large.option("path", scratch(spark, "payloads")).mode("overwrite").saveAsTable(name)
    small = written(once(F.col("size") < least), "payloads")
    release_shuffles(spark)
    return Archive(records, spark.table(name), small, name)


def reconstruct(store: Archive) -> DataFrame:
    """(record_id, page_id, head, payload): the original bytes of each record are head and payload; a revisit has none of the latter."""
    own = store.records.where("type = 'response'")
    stored = own.where("large").join(store.large, "sha256").unionByName(own.where("not large").join(store.small, "sha256"))
    bare = store.records.where("type <> 'response'").withColumn("payload", F.lit(b"").cast("binary"))
    return stored.unionByName(bare).select("record_id", "page_id", "head", "payload", "sha256", "type")


def write(store: Archive, uri: str | None = None) -> DataFrame:
    """Write WARC files; the manifest (path, records) of those that count."""
    spark = store.records.sparkSession
    uri = uri or scratch(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, sink, n = TaskContext.get(), None, 0
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for b in batches:
            for head, payload, sha256, kind in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == "response" and hashlib.sha256(payload).hexdigest() != sha256:
                    raise ValueError(f"payload {sha256} is damaged in the store")
                if sink is None:
                    fs, folder = open_fs(uri)
                    sink = fs.open_output_stream(f"{folder}/{name}", compression=None)
                sink.write(gzip.compress(head + payload + b"\r\n\r\n", compresslevel=4, mtime=0))
                n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{uri}/{name}"], "records": pa.array([n], pa.int64())})

    rows = reconstruct(store).select("head", "payload", "sha256", "type")
    return written(rows.mapInArrow(trimmed(run), "path string, records long"), "warc-manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC file, gzipped by record or not."""
    held, source = bytearray(), _plain(stream)

    def upto(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            more = next(source, b"")
            if not more:
                return False
            held += more
        return True

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not upto(len(held) + 1):
                if held.strip():
                    raise ValueError("truncated WARC header")
                return
        first, *lines = held[:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        if not upto(end + 4 + size + 4):
            raise ValueError("truncated WARC block")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size + 4]  # moves the start, not the bytes


def _plain(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a file, its gzip members decompressed one after the other.

    What is left of a chunk is copied for each member, so chunks are small.
    """
    data = stream.read(chunk)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield bytes(data)
            data = stream.read(chunk)
        return
    inflate = zlib.decompressobj(31)
    while data:
        out = inflate.decompress(data)
        if out:
            yield out
        if inflate.eof:
            data = inflate.unused_data or stream.read(chunk)
            inflate = zlib.decompressobj(31)
        else:
            data = stream.read(chunk)


def read(manifest: DataFrame) -> DataFrame:
    """(record_id, page_id, type, url, sha1, size, refers, payload) of every record in the files of ``manifest(path)``.

    A response's payload is checked against its digest.  ``size`` is that of the
    HTTP header's Content-Length, the full payload's; ``sha1`` is hexadecimal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uuid = lambda s: s.removeprefix("<urn:uuid:").removesuffix(">") if s else None
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            fs, at = open_fs(path)
            with fs.open_input_stream(at, compression=None) as stream:
                out: list[tuple] = []
                for fields, block in parse(stream):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind = fields["warc-type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['warc-record-id']}: payload does not match its digest")
                    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    page = fields.get("x-page-id")
                    out.append((uuid(fields["warc-record-id"]), int(page) if page else None, kind, fields["warc-target-uri"], digest, size, uuid(fields.get("warc-refers-to")), payload if kind == "response" else None))
                    if len(out) == 500:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["record_id", "page_id", "type", "url", "sha1", "size", "refers", "payload"]

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    files = manifest.select("path").repartition(shuffle_parts(manifest.sparkSession))
    return files.mapInArrow(trimmed(run), "record_id string, page_id long, type string, url string, sha1 string, size long, refers string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """``records`` (from ``read``, without payloads) with the page_id of the response that each revisit refers to."""
    light = written(records.drop("payload"), "warc-index")
    aim = light.where("type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    plain = light.where("refers is null").withColumn("refers_to", F.lit(None).cast("long"))
    return plain.unionByName(light.where("refers is not null").join(aim, "refers"))
