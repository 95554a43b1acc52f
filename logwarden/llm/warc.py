"""WARC archives: written by Spark's own file writer and read by a sequential reader.

Archives hold one gzip member per record.  They are plain files in any file system that Spark writes to, committed task
by task.  The text writer appends its line separator to each value; a gzip member ends with the high byte of its length,
which is 0 below 16 MiB, so that byte is left out and the separator puts it back.  A longer record is followed by an empty
member, whose last byte is 0 too.

The reader goes through a file once: it feeds zlib small slices, frames each record by its content length and verifies
both digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm.common import keyed, scratch_folder, tidy_arrow

#: Payloads of at least this many bytes are stored once.
LEAST_SHARED = 1000
RECORDS_PER_FILE = 2000
SLICE = 64 << 10
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    """A record whose framing or digest is wrong."""


def digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, shared: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the page ``refers_to`` without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if shared else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{len(payload)}")
    # a line break would end the header
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if shared else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {digest32(payload)}", f"WARC-Block-Digest: {digest32(block)}",
        f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if shared:
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member (followed by an empty one if it does not end with 0) without its last byte."""
    out = _gzip(data)
    return (out if out[-1] == 0 else out + _gzip(b""))[:-1]


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_members(data: memoryview) -> Iterator[bytes]:
    """Contents of the gzip members of an archive, in order; empty members are skipped."""
    at = 0
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(data):
                raise BadRecord("the archive ends within a member")
            part = data[at : at + SLICE]
            try:
                parts.append(unpack.decompress(part))
            except zlib.error as error:
                raise BadRecord(f"no gzip member at byte {at}: {error}") from error
            at += len(part) - len(unpack.unused_data)
        found = b"".join(parts)
        if found:
            yield found


def parse(data: bytes) -> dict:
    """Header fields, block and payload of one record, after its framing and digests have been verified."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise BadRecord("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError) as error:
        raise BadRecord("no content length") from error
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise BadRecord("the content length does not frame the record")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != digest32(block):
        raise BadRecord("the block digest is wrong")
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block
    if fields.get("warc-type") != "revisit" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != digest32(payload):
        raise BadRecord("the payload digest is wrong")
    return {"fields": fields, "block": block, "payload": payload}


def _hex(label: str | None) -> str | None:
    return base64.b32decode(label.removeprefix("sha1:")).hex() if label else None


def with_references(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """``pages`` as ``page_id, url, html`` with ``refers_to``: the page whose equal payload is stored, for those that revisit it.

    Of equal payloads of at least ``LEAST_SHARED`` bytes the one with the largest id is stored.  Only digests are grouped;
    rows that are repeated with the same id are all responses if that id is the largest, and so are rows with a null id
    where all ids of the payload are null.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col("url").alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= LEAST_SHARED, F.sha1(F.col("html").cast("binary"))))
    groups = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
        for start in range(0, batch.num_rows, 50):
            rows = zip(*(c.slice(start, 50).to_pylist() for c in columns), strict=True)
            made = [member(record(p, u, (h or "").encode(), r, r is not None)) for p, u, h, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", text_col: str = "html") -> None:
    """Write a record per row of ``pages`` (``id_col``, ``url``, ``text_col``) into archives below ``path``.

    A null text is an empty payload, a null url an empty target; a null id is left out of the record.
    """
    tidy_arrow(pages.sparkSession)
    members = with_references(pages, id_col, text_col).mapInArrow(_records, "member binary")
    # the cast leaves the bytes as they are, and the writer writes them as they are
    members.select(F.col("member").cast("string").alias("value")).write.mode("error").option("lineSep", "\0").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


_READ = (
    "archive string, n long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                for n, data in enumerate(read_members(memoryview(content.as_buffer()))):
                    found = parse(data)
                    f, payload = found["fields"], found["payload"]
                    kind = f.get("warc-type")
                    length = int(f["x-payload-length"]) if kind == "revisit" and "x-payload-length" in f else len(payload)
                    page, refers = f.get("x-page-id"), f.get("x-refers-to-page-id")
                    rows.append((
                        path.as_py(), n, int(page) if page else None, f.get("warc-target-uri"), length,
                        _hex(f.get("warc-payload-digest")) or hashlib.sha1(payload).hexdigest(), kind,
                        int(refers) if refers else None, payload if payloads and kind != "revisit" else None,
                    ))
                    size += len(payload) * payloads
                    if len(rows) >= 500 or size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives below ``path``: ``archive, n, page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload``.

    Digests are bare hexadecimal SHA-1 values; a revisit has the length and digest of the payload that it refers to and no
    payload of its own.  A record that is cut off or fails its digest raises :class:`BadRecord`.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # one archive at a time
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(payloads), _READ)


def archive_pages(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{scratch_folder(spark)}/warc"
    write_warc(pages, path, id_col, text_col)
    return read_warc(spark, path, payloads=False)
