"""WARC archives with the index first.

Each record is a gzip member of its own (the usual .warc.gz form), so any record can be read alone.
Tasks write archives below a shared folder, each attempt under names of its own, and return the index
rows (URL, digest, archive, offset, length) of what they wrote; the index holds the rows of the attempts
that counted, and files of lost attempts are never read.  Reading sorts the selected index rows by
archive and offset, merges near ranges and reads each merged range once.

Which records are revisits comes from a pre-aggregated table of payloads that occur more than once.  While that
table's counted rows are few it is broadcast and pages are written where they are read; a larger one is joined by
digest, which shuffles the pages (Spark may split a hot payload).

Defined results: a null html is an empty payload; a null url has no WARC-Target-URI; control
characters of a url are percent-encoded in the header (the index keeps the url itself); a null
page_id revisits the smallest page_id with its payload where there is one, else it is a response;
equal page_ids with equal payloads are all the response; an empty table gives no rows; other columns
are ignored.  A task holds one record and one merged range at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small, stored, table

CRLF = "\r\n"

#: Bytes of an archive, bytes that one task's key covers, bytes that a task reads, longest merged read, largest gap read over; gzip level.
ARCHIVE, BLOCK, TASK, READ, GAP, LEVEL = 64 << 20, 4 << 20, 16 << 20, 4 << 20, 64 << 10, 5

#: Digits of Spark's conv and of RFC 4648 (fixed values).
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """SHA-1 as 32 upper-case base-32 characters, ten hex digits at a time."""
    digest = F.sha1(data)
    part = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*part), DIGITS, BASE32)


def record(page_id, url, html: bytes, size: int, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC record, its closing empty lines included."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html
        lines.append("Content-Type: application/http; msgtype=response")
    else:
        block = b""
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {size}"]
    lines.append(f"Content-Length: {len(block)}")
    return CRLF.join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Payloads that occur once never meet a join partner; the others' smallest ids come from a
    pre-aggregated table, broadcast or joined by its counted size.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.col("html").cast("binary"))})
    twice = base.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("first_id").isNotNull() & (F.col("payload_bytes") >= least)).drop("n")
    joined = base.join(small(stored(twice, "payloads"), 96), ["payload_digest", "payload_bytes"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, F.lit("revisit")).otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def archive_writer(path: str, date: str):
    """A function for mapInArrow: writes the records it gets, gives their index rows."""

    def write(batches):
        from pyarrow import fs

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        store, place = fs.FileSystem.from_uri(path)
        out, name, at = None, "", 0
        for batch in batches:
            page_ids, urls, sizes, digests, kinds, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))
            rows = []
            for i, html in enumerate(batch.column(2)):
                if out is None or at >= ARCHIVE:
                    if out is None:
                        store.create_dir(place, recursive=True)
                    else:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{place}/{name}", compression=None)
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                body = html.as_buffer().to_pybytes() if kinds[i] == "response" else b""
                data = pack.compress(record(page_ids[i], urls[i], body, sizes[i], digests[i], kinds[i], refers[i], date)) + pack.flush()
                out.write(data)
                rows.append((page_ids[i], urls[i], digests[i], f"{path}/{name}", at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write one record for each page below path; gives the stored index."""
    index = records(pages, least).mapInArrow(archive_writer(path, date), "page_id long, url string, payload_digest string, path string, offset long, length long")
    return stored(index, "warc-index")


def parse(record: bytes) -> tuple[dict[str, str], memoryview]:
    """Header fields (names in lower case) and block of one record; the header is as long as it is."""
    end = record.find(b"\r\n\r\n")
    lines = record[: end if end >= 0 else len(record)].decode().split(CRLF)
    if end < 0 or not lines[0].startswith("WARC/1."):
        raise ValueError(f"no record header: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = memoryview(record)[end + 4 :]
    if len(block) != int(fields["content-length"]) + 4:
        raise ValueError(f"record of {fields['content-length']} bytes has {len(block) - 4}")
    return fields, block[:-4]


def _read(batches):
    from pyarrow import fs

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    opened, source = None, None

    def row(member: memoryview) -> tuple:
        fields, block = parse(zlib.decompress(member, 31))
        number = lambda x: None if x is None or x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
        if fields["warc-type"] == "revisit":
            size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
        else:
            at = bytes(block).find(b"\r\n\r\n") + 4
            size, digest = len(block) - at, base64.b32encode(hashlib.sha1(block[at:]).digest()).decode()
            if "sha1:" + digest != fields["warc-payload-digest"]:
                raise ValueError(f"payload of {fields['warc-record-id']} is not what was written")
        return number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields.get("warc-refers-to"))

    for batch in batches:
        wanted = list(zip(*(batch.column(i).to_pylist() for i in range(3))))  # path, offset, length: sorted
        at, out = 0, []
        while at < len(wanted):
            path, first, size = wanted[at]
            stop, end = at + 1, first + size
            while stop < len(wanted) and wanted[stop][0] == path and wanted[stop][1] - end <= GAP and wanted[stop][1] + wanted[stop][2] - first <= READ:
                end = max(end, wanted[stop][1] + wanted[stop][2])
                stop += 1
            if path != opened:
                store, place = fs.FileSystem.from_uri(path)
                source, opened = store.open_input_file(place), path
            data = memoryview(source.read_at(end - first, first))
            out += [row(data[o - first : o - first + n]) for _, o, n in wanted[at:stop]]
            at = stop
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)


def read_records(index: DataFrame) -> DataFrame:
    """Read the selected index rows' records: ranges sorted by archive and offset, merged where near.

    The number of tasks comes from the bytes to read (index rows are tiny, so Spark itself would take one)."""
    tasks = int((index.agg(F.sum("length")).first()[0] or 0) // TASK) + 1
    tasks = max(tasks, index.sparkSession.sparkContext.defaultParallelism)
    ranges = index.select("path", "offset", "length").repartition(tasks, "path", F.floor(F.col("offset") / BLOCK)).sortWithinPartitions("path", "offset")
    return ranges.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, then read all of them back through the index."""
    return read_records(write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


OP5_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS x FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest FROM h),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""
