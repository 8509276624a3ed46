import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from trapline.llm.warc import DICTIONARY_FRAME, parse, payload_digest, read_archives, record, write_archives

PAGE = "page_id bigint, url string, html string"


def plain(pages):
    least = {}
    for page, _, html in pages:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    out = []
    for page, _, html in pages:
        body, first = (html or "").encode(), least.get(html or "")
        revisit = first is not None and page != first
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, len(body), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark, tmp_path, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    manifest = write_archives(pages, f"{tmp_path}/warc")
    found = read_archives(manifest)
    expected = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert result(found) == plain(expected)
    payloads = {r.page_id: (r.url, r.payload) for r in found.collect() if r.record_type == "response"}
    assert all(payloads[p] == (u, h.encode()) for p, u, h in expected if p in payloads)
    assert manifest.agg(F.sum("records")).first()[0] == len(expected)


def test_odd_rows(spark, tmp_path):
    pages = [
        (5, "u\r\nX: y", "same"), (3, None, "same"), (9, "", "same"), (7, "u", None), (8, "u", ""), (1, "u", "é\r\n\r\nWARC/1.1"),
        (None, "u", "same"), (None, "u", "alone"), (2, "u", "z" * 3_000_000), (4, "u", "twice"), (4, "u", "twice"), (-6, "u", "minus"),
    ]
    df = spark.createDataFrame(pages, PAGE).repartition(4).withColumns({"content": F.lit(1), "first": F.lit(2), "payload": F.lit("p")})
    found = read_archives(write_archives(df, f"{tmp_path}/w"))
    assert result(found) == plain(pages)
    assert {r.page_id: r.url for r in found.collect()}[5] == "u%0D%0AX: y"


def test_archive_format(spark, tmp_path, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").coalesce(1)
    archive = write_archives(pages, f"{tmp_path}/warc").first()
    data = open(archive.archive, "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == DICTIONARY_FRAME and len(data) == archive.bytes
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    rest, count = data[8 + size :], 0
    while rest:
        frame = reader.decompressobj()
        headers, _ = parse(frame.decompress(rest))
        rest, count = frame.unused_data, count + 1
    assert count == archive.records and headers["WARC-Type"] in ("response", "revisit")
    raw = sum(len(h[0].encode()) for h in pages.select("html").collect())
    assert archive.bytes - size < raw / 2


def test_damage_is_noticed(spark, tmp_path):
    whole = record(1, "u", b"body", None, False)
    assert parse(whole)[1].endswith(b"body") and payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    with pytest.raises(ValueError):
        parse(whole[:-3])
    manifest = write_archives(spark.createDataFrame([(1, "u", "body " * 99)], PAGE), f"{tmp_path}/w")
    path = manifest.first().archive
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-5])
    with pytest.raises(Exception, match="ends inside|checksum|ZstdError|corrupt"):
        read_archives(manifest).collect()


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], PAGE)
    assert read_archives(write_archives(empty, f"{tmp_path}/w")).count() == 0
