"""Media columns: payloads in ISO base media containers, described from their sample tables.

``pack`` builds one container for a payload: ``ftyp``, ``moov`` with one track of 8-bit samples
(codec ``raw ``), ``mdat``.  ``probe`` walks the nested boxes of any container, decodes the sample
tables (stts, stsc, stsz, stco/co64, stss) and gives codec, duration and the byte ranges of the key
frames without touching the media data.  ``unpack`` reads a track's bytes back through its tables.

Defined results: a null text is an empty payload (64 zero bytes once padded); a null container
probes to null; bytes that are no container probe to an ``error`` and nothing else; equal texts give
equal bytes (no time stamps are written).  Rows are handled one by one in Arrow batches, so very long
texts need memory for one text and its container only.  Input columns other than the named ones are
not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Bytes of one sample, samples of one chunk (the first of each chunk is a key frame), samples a second.
FRAME, CHUNK, RATE = 64, 64, 8000

#: Boxes that hold boxes only (fixed values of the format).
NESTED = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"mfra", b"udta"}

#: Rows are handed on after so many bytes.
FLUSH = 8 << 20


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of FRAME."""
    return text + bytes((-len(text)) % FRAME or (0 if text else FRAME))


UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FTYP = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ", b"isom")
HDLR = full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
DINF = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
SMHD = full(b"smhd", bytes(4))
STSD = full(b"stsd", struct.pack(">I", 1), box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16)))


def pack(payload: bytes) -> bytes:
    """A container whose only track holds payload, len(payload) a multiple of FRAME."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK)
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] * (chunks > 1 or last == CHUNK) + ([(chunks, last, 1)] if last != CHUNK else [])
    long = len(payload) >= 1 << 31
    length = len(payload)

    def head(first: int) -> bytes:
        wide = ">%dQ" if long else ">%dI"
        offsets = full(b"co64" if long else b"stco", struct.pack(">I", chunks), struct.pack(wide % chunks, *range(first, first + chunks * CHUNK * FRAME, CHUNK * FRAME)))
        keys = full(b"stss", struct.pack(">I", chunks), struct.pack(">%dI" % chunks, *range(1, chunks * CHUNK + 1, CHUNK)))
        tables = box(b"stbl", STSD, full(b"stts", struct.pack(">III", 1, n, FRAME)), full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)), full(b"stsz", struct.pack(">II", FRAME, n)), offsets, keys)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), UNITY, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, length, 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return FTYP + box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, HDLR, box(b"minf", SMHD, DINF, tables))))

    front = 16 if long else 8
    size = len(head(0))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + length) if long else struct.pack(">I4s", 8 + length, b"mdat")
    return head(size + front) + mdat + payload


def walk(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of the body, end) of each box, parents before children."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else at + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {at} leaves its parent")
        yield kind, body, stop
        if kind in NESTED:
            yield from walk(data, body, stop)
        at = stop


def tracks(data: memoryview) -> list[dict]:
    """Decoded headers and sample tables of every track."""
    out: list[dict] = []
    for kind, a, b in walk(data, 0, len(data)):
        if kind == b"trak":
            out.append({"stss": None, "offsets": [], "stsc": [], "stts": [], "codec": None, "rate": 0, "duration": 0, "fixed": 0, "sizes": (), "n": 0})
            continue
        if not out:
            continue
        now = out[-1]
        count = struct.unpack_from(">I", data, a + 4)[0] if b - a >= 8 else 0
        if kind == b"mdhd":
            now["rate"], now["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        elif kind == b"stsd" and count:
            now["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"stts":
            now["stts"] = list(struct.iter_unpack(">II", data[a + 8 : a + 8 + 8 * count]))
        elif kind == b"stsc":
            now["stsc"] = list(struct.iter_unpack(">III", data[a + 8 : a + 8 + 12 * count]))
        elif kind == b"stsz":
            now["fixed"], now["n"] = struct.unpack_from(">II", data, a + 4)
            now["sizes"] = () if now["fixed"] else struct.unpack_from(">%dI" % now["n"], data, a + 12)
        elif kind in (b"stco", b"co64"):
            now["offsets"] = struct.unpack_from(">%d%s" % (count, "I" if kind == b"stco" else "Q"), data, a + 8)
        elif kind == b"stss":
            now["stss"] = struct.unpack_from(">%dI" % count, data, a + 8)
    return out


def chunk_runs(track: dict) -> Iterator[tuple[int, int, int]]:
    """(first sample from 0, samples, byte offset) of each chunk."""
    sample, runs = 0, track["stsc"]
    for i, (first, per, _) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(track["offsets"]) + 1
        for chunk in range(first, last):
            yield sample, per, track["offsets"][chunk - 1]
            sample += per


def key_ranges(track: dict) -> list[tuple[int, int]]:
    """(byte offset, length) of every key frame; without an stss all samples are key frames."""
    fixed, sizes = track["fixed"], track["sizes"]
    keys = iter(track["stss"]) if track["stss"] is not None else iter(range(1, track["n"] + 1))
    out, key = [], next(keys, None)
    for first, per, at in chunk_runs(track):
        done = first
        while key is not None and key <= first + per:
            at += fixed * (key - 1 - done) if fixed else sum(sizes[done : key - 1])
            done = key - 1
            out.append((at, fixed or sizes[key - 1]))
            key = next(keys, None)
    return out


def unpack(data: memoryview, track: dict) -> bytes:
    fixed, sizes = track["fixed"], track["sizes"]
    return b"".join(data[at : at + (fixed * per if fixed else sum(sizes[first : first + per]))] for first, per, at in chunk_runs(track))


def describe(track: dict) -> str:
    keys = ",".join(f"{a}+{n}" for a, n in key_ranges(track))
    return f"codec={track['codec'].strip()};rate={track['rate']};duration={track['duration']};samples={track['n']};keyframes={keys}"


def flushed(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each given with its size in bytes."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _stored(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows():
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_buffer().to_pybytes() if text.is_valid else b""
                yield len(text), (key, len(text), pack(pad(text)))

    yield from flushed(rows(), schema)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container that holds the padded UTF-8 text."""
    return docs.select("doc_id", "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _probed(batches):
    schema = pa.schema([("codec", pa.string()), ("duration_s", pa.float64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))), ("error", pa.string())])

    def rows():
        for batch in batches:
            for media in batch.column(0):
                if not media.is_valid:
                    yield 0, (None, None, None, None)
                    continue
                try:
                    track = tracks(memoryview(media.as_buffer()))[0]
                    keys = [{"offset": a, "length": n} for a, n in key_ranges(track)]
                    yield 16 * len(keys), (track["codec"], track["duration"] / track["rate"] if track["rate"] else None, keys, None)
                except (ValueError, IndexError, struct.error, AttributeError) as x:
                    yield 0, (None, None, None, str(x) or "no track")

    yield from flushed(rows(), schema)


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """codec, duration_s, keyframes (byte ranges) and error for a column of containers, one row each."""
    return media.select(column).mapInArrow(_probed, "codec string, duration_s double, keyframes array<struct<offset:long,length:long>>, error string")


def _read_back(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def rows():
        for batch in batches:
            for key, size, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = memoryview(media.as_buffer())
                track = tracks(data)[0]
                payload, feature = unpack(data, track), describe(track)
                yield 300 + len(feature), (key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature)

    yield from flushed(rows(), schema)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as a container, then describe and verify what the table holds."""
    media = stored(media_table(table(spark, sf_dir, "documents")), "media")
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
