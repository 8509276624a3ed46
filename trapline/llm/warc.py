"""WARC archives of pages, compressed record by record with a dictionary of their own.

An archive (``.warc.zst``) begins with a skippable frame that holds a Zstandard dictionary; every record is a frame of
its own, compressed with it, so that one can be read without the others. The dictionary is built from a bounded sample
of the records. Records with a payload seen under a smaller page id are revisits: they name that page and hold no payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.session import settle

DICTIONARY_FRAME = 0x184D2A5D  # magic number of the skippable frame
DICTIONARY_BYTES = 64 * 1024
SAMPLE_RECORDS = 500  # records the dictionary is built from: those with the smallest hashes of their id
LEVEL = 3
DATE = "2026-01-01T00:00:00Z"
_CHUNK = 1 << 16
_ID = "urn:trapline:page:"

MANIFEST = "archive string, records bigint, bytes bigint"
RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, payload binary"
)


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<{_ID}{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    return int(urn[len(_ID) + 1 : -1]) if len(urn) > len(_ID) + 2 else None


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        headers.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        headers.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        headers.append(f"WARC-Refers-To: {_urn(first)}")
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; a damaged record is an error."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if not found or lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, rest[:size]


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _frames(source, dictionary_of: list[bytes]) -> Iterator[bytes]:
    """Decompressed frames of one archive, read in chunks; the dictionary is put into ``dictionary_of``."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive has no dictionary frame")
    dictionary_of.append(source.read(size))
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary_of[0]))
    held = source.read(_CHUNK)
    while held:
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not held:
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(held))
            held = frame.unused_data if frame.eof else source.read(_CHUNK)
        yield b"".join(parts)
        held = held or source.read(_CHUNK)


def write_archives(pages: DataFrame, folder: str, sample: int = SAMPLE_RECORDS, level: int = LEVEL) -> DataFrame:
    """Write an archive per partition into ``folder``; returns the ``archive``, ``records``, ``bytes`` of each.

    ``pages`` has ``page_id``, ``url``, ``html``; ``folder`` is shared by driver and executors. A missing html is an empty
    payload, a missing url leaves out its header. Rows that share page id and payload are the same page: each is
    written alike. A row without id is a response only if no row with its payload has an id. A task that runs again
    writes a new file; only the files in the returned manifest, which is stored, count.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    )
    chosen = rows.orderBy(F.xxhash64("page_id"), "page_id").limit(sample).select("payload")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [record(0, "", p, None, False) for b in batches for p in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([build_dictionary(samples)], pa.binary())], names=["dictionary"])

    dictionary = bytes(chosen.coalesce(1).mapInArrow(train, "dictionary binary").first()[0])

    keyed = rows.withColumn("content", F.unhex(F.sha2("payload", 256)))
    shared = keyed.groupBy("content").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    typed = keyed.join(shared.select("content", "first"), "content", "left").select(
        "page_id", "url", "payload", "first",
        (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
        trained = zstandard.ZstdCompressionDict(dictionary)
        press = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
        out, count, size = None, 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                    size += out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                size += out.write(press.compress(record(*row)))
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64()), pa.array([size], pa.int64())],
                names=["archive", "records", "bytes"],
            )

    return settle(typed.mapInArrow(write, MANIFEST))


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives in ``manifest``, checked against its digest and length.

    A revisit has no payload; its length and digest are those of the page it refers to.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, base = _open(path)
                with files.open_input_stream(base, compression=None) as source:
                    held, weight = [], 0
                    for data in _frames(source, []):
                        headers, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = kind == "revisit"
                        if not revisit and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
                        held.append((
                            _page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, digest, kind,
                            _page(headers["WARC-Refers-To"]) if revisit else None, None if revisit else payload,
                        ))
                        weight += len(data)
                        if weight > 16 << 20:
                            yield pa.RecordBatch.from_arrays(_columns(held), schema=_SCHEMA)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays(_columns(held), schema=_SCHEMA)

    paths = manifest.select("archive").repartition(max(1, manifest.count()))
    return paths.mapInArrow(read, RECORDS)


_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(column, kind) for column, kind in zip(zip(*rows), _SCHEMA.types)]
