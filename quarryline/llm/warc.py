"""WARC archives: a writer, and a reader that splits them.

Each record is a gzip member of its own. Spark's text sink writes the members,
so archives are committed like any other output, on any file system Spark
knows: a row is a member without its last byte, and that byte, always zero, is
the line separator (a record of 16 MiB or more is followed by an empty member).

The reader gives each task a byte range. The task scans for gzip magic,
validates a candidate by its header and by decoding the first bytes to a WARC
version line, and owns the records that start in its range; it follows a
member to its end, if need be past the range, and goes on from there.

Of records with equal payloads of ``least`` bytes or more, that with the
smallest id is the response and the others revisit it.

Defined cases: a null payload is empty; a null id is written as ``null`` and
never revisited; rows that repeat the smallest id are responses both; other
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import dealing_keys, durable, shared_dir

MAGIC = b"\x1f\x8b\x08"
ID = "urn:page:"
#: Bytes of an archive that one task owns, and bytes read at once.
RANGE_BYTES = 64 << 20
CHUNK = 1 << 20
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record."""
    block = b"" if refers_to is not None else _HTTP + payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is zero."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = squeeze.compress(data) + squeeze.flush()
    if out[-1]:  # the length's highest byte
        empty = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += empty.flush()
    return out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> None:
    """Writes a record for each row of ``pages`` to archives in the folder ``path``."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    # Only ids and digests are gathered by payload; a payload in a third of all pages stays where it is.
    named = own.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = durable(named.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id"))
    refers = named.join(first, "digest").where("page_id > first_id").select("page_id", "digest", F.col("first_id").alias("refers_to")).distinct()
    rows = own.join(refers, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [member(record(*row))[:-1] for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = rows.mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\x00").text(path)


def _file(path: str):
    """An open random-access file of any store that Arrow knows."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class _Window:
    """A file as far as it has been read, from ``start`` on."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data, self.size = file, start, bytearray(), file.size()

    def fill(self, end: int) -> None:
        """Reads on until the byte before ``end``, if there is one."""
        have = self.start + len(self.data)
        if have < min(end, self.size):
            self.file.seek(have)
            self.data += self.file.read(max(CHUNK, end - have))

    def bytes(self, a: int, b: int) -> bytes:
        self.fill(b)
        return bytes(self.data[a - self.start : b - self.start])

    def forget(self, before: int) -> None:
        if before - self.start > CHUNK:
            del self.data[: before - self.start]
            self.start = before


def _valid(window: _Window, at: int) -> bool:
    """Whether a WARC record's member begins at ``at``: its header's reserved
    bits are clear and its first bytes decode to a version line."""
    head = window.bytes(at, at + 512)
    if len(head) < 18 or head[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def members(file, start: int, end: int) -> Iterator[bytes]:
    """The decoded members that begin in [start, end)."""
    window, at = _Window(file, start), start
    while at < min(end, window.size):
        if window.bytes(at, at + 3) != MAGIC or not _valid(window, at):
            window.fill(at + CHUNK)
            spot = window.data.find(MAGIC, at + 1 - window.start)
            at = window.start + spot if spot >= 0 else max(at + 1, window.start + len(window.data) - 2)
            window.forget(at)
            continue
        decode, parts, at_end = zlib.decompressobj(31), [], at
        while not decode.eof:
            more = window.bytes(at_end, at_end + 65536)
            if not more:
                raise EOFError(f"the member at byte {at} is cut off")
            parts.append(decode.decompress(more))
            at_end += len(more)
        at = at_end - len(decode.unused_data)
        yield b"".join(parts)
        window.forget(at)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields (lower-case names) and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return fields, rest[: int(fields.get("content-length", len(rest)))]


def _row(data: bytes) -> tuple:
    fields, block = parse(data)
    bare = lambda x: x.strip("<>").removeprefix(ID) if x else None
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    payload, size = None, int(fields.get("x-payload-bytes", -1))
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        found = sha256(payload).hexdigest()
        if digest not in (None, found):
            raise ValueError(f"record {fields.get('warc-record-id')}: its payload does not have its digest")
        digest, size = found, len(payload)
    return bare(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")), digest, None if size < 0 else size, payload


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[tuple[str, int, int]]:
    """The byte ranges of all archives in the folder ``path``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    out = []
    for status in folder.getFileSystem(conf).listStatus(folder):
        name, size = status.getPath().toString(), status.getLen()
        if status.isFile() and not status.getPath().getName().startswith(("_", ".")):
            out += [(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name, a, min(a + range_bytes, size)) for a in range(0, size, range_bytes)]
    return out


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """One row per record (ids without their ``urn:page:``). A response's
    payload is checked against its digest; a revisit's payload is null, its
    bytes and digest are those of the payload it stands for."""
    parts = ranges(spark, path, range_bytes)
    keys = dealing_keys(np.arange(len(parts))).tolist()
    rows = [(*p, k) for p, k in zip(parts, keys, strict=True)]
    plan = spark.createDataFrame(rows, "path string, a long, b long, deal int").repartition(max(1, len(parts)), "deal").drop("deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for name, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                size = 0
                with _file(name) as file:
                    for data in members(file, a, b):
                        if data:
                            row = _row(data)
                            rows.append(row if payloads else (*row[:-1], None))
                            size += len(data) if payloads else 200
                        if size > (8 << 20):
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)

    return plan.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, range_bytes: int = 4 << 20) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads their records back."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, id_col, url_col, payload_col, least)
    return read_warc(pages.sparkSession, path, range_bytes, payloads=False)
