import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from marketloom.llm import warc


def pages(spark):
    same = "<p>copy</p>"
    rows = [(1, "http://a/", same), (2, "http://b/", same), (3, None, None), (4, "http://c/", ""), (5, "http://d\r\n/", "é" * 50_000), (6, "http://e/", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 50), (2, "http://b/", same)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload int, sha1 string")


@pytest.mark.parametrize("range_bytes", [97, 5000, 1 << 22])
def test_every_record_is_read_once(spark, range_bytes):
    files = warc.write_warc(pages(spark), warc.shared_folder(spark), file_bytes=400)
    assert files.count() > 1
    found = warc.read_warc(files, range_bytes).collect()
    assert sorted(r.record_id for r in found) == sorted(f"urn:page:{i}" for i in (1, 2, 2, 3, 4, 5, 6))
    body = {r.record_id: bytes(r.payload) for r in found if r.record_type == "response"}
    assert body["urn:page:5"] == ("é" * 50_000).encode() and body["urn:page:3"] == b""


def test_archive_pages(spark):
    found = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(spark, pages(spark)).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert (1, 11, digest("<p>copy</p>"), "response", None) in found and (2, 11, digest("<p>copy</p>"), "revisit", 1) in found
    assert (3, 0, digest(""), "response", None) in found and (4, 0, digest(""), "revisit", 3) in found
    assert (5, 100_000, digest("é" * 50_000), "response", None) in found
    assert warc.archive_pages(spark, pages(spark).limit(0)).count() == 0
    assert warc.archive_pages(spark, pages(spark).withColumn("page_id", F.lit(None).cast("long"))).count() == 7


def test_false_magic_and_broken_archives():
    one, two = warc.warc_record("response", 1, "u", b"\x1f\x8b\x08" * 9, "D", None), warc.warc_record("response", 2, "u", b"b" * 9000, "D", None)
    data = b"\x1f\x8b\x08junk" + one + gzip.compress(b"not a record") + two
    read = lambda a, z, d=data: [at for at, _ in warc.records_in_range(io.BytesIO(d), a, z, len(d))]
    starts = [7, len(data) - len(two)]
    assert read(0, len(data)) == starts
    for split in range(0, len(data), 61):  # each record belongs to the range where it starts
        assert read(0, split) + read(split, len(data)) == starts
    assert read(0, len(data) - 5, data[:-5]) == starts[:1]
