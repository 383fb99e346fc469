"""WARC archives: a writer with revisit records, and a splittable reader.

Reader: a task gets a byte range of an archive, looks for gzip magic in it, and takes a place for a member if it inflates to
the start of a WARC header that parses. It owns the records whose members start inside its range and reads on beyond its end for the last one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.text import arrow_map, cut, filesystem, passing_tables, payload, shared_folder, text_parts

MAGIC = b"\x1f\x8b\x08"
#: An archive is closed and the next begun beyond so many bytes; ranges of a reading task; bytes of a batch of records.
FILE_BYTES, RANGE_BYTES, BATCH_BYTES = 256 << 20, 4 << 20, 8 << 20
#: Compressed bytes that are inflated at a time.
STEP_BYTES = 1 << 16
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def warc_record(kind: str, page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header only; X-Payload-Length has the full payload's bytes."""
    block = HTTP_HEAD.format(len(body)).encode() + (body if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, f'{digest} {url}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(body)))]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip_member(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n")


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a WARC header (names in lower case) and its length; None if this is none or not whole."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def is_member(data: bytes, at: int) -> bool:
    """Whether a gzip member starts here that holds a WARC record: its header is decoded."""
    try:
        head = zlib.decompressobj(31).decompress(data[at : at + 65536], 65536)
    except zlib.error:
        return False
    found = parse_head(head)
    return found is not None or (len(head) == 65536 and head.startswith(b"WARC/"))


def inflated(data: memoryview, at: int, more: Callable[[], bytes]) -> tuple[bytes, int] | None:
    """The member that starts at `at` and its compressed bytes; what lies beyond the data comes from `more`. None if it breaks off. Taken in steps, so nothing behind the member is copied."""
    unpack, parts, used = zlib.decompressobj(31), [], 0
    while not unpack.eof:
        step = bytes(data[at + used : at + used + STEP_BYTES]) or more()
        if not step:
            return None
        parts.append(unpack.decompress(step))
        used += len(step) - len(unpack.unused_data)
    return b"".join(parts), used


def records_in_range(source, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated record) of each member that starts at start or later, and before end."""
    source.seek(start)
    data = source.read(min(end + 65536, size) - start)  # enough to validate a candidate at the range's end
    view, at, after = memoryview(data), 0, start + len(data)

    def beyond() -> bytes:  # only the last record of the range reaches there
        nonlocal after
        source.seek(after)
        found = source.read(min(RANGE_BYTES, size - after)) if after < size else b""
        after += len(found)
        return found

    while (at := data.find(MAGIC, at)) >= 0 and start + at < end:
        if not is_member(data, at):
            at += 1
            continue
        after = start + len(data)
        try:
            found = inflated(view, at, beyond)
        except zlib.error:
            at += 1  # it only looked like a member
            continue
        if found is None:
            return  # the archive breaks off in this record
        yield start + at, found[0]
        at += found[1]


RECORD_SCHEMA = "path string, offset long, record_type string, target_uri string, record_id string, refers_to_id string, payload_bytes long, payload_digest string, payload binary"
RECORD_NAMES = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]


def parse_record(raw: bytes, with_payload: bool) -> tuple | None:
    parsed = parse_head(raw)
    if parsed is None:
        return None
    fields, at = parsed
    block = raw[at : at + int(fields["content-length"])]
    body = block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block
    if fields["warc-type"] == "revisit":
        n, digest = int(fields.get("x-payload-length", "0")), fields.get("warc-payload-digest", "").partition(":")[2]
    else:
        n, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
    strip = lambda x: x.strip("<>") if x else None
    return fields["warc-type"], fields.get("warc-target-uri"), strip(fields.get("warc-record-id")), strip(fields.get("warc-refers-to")), n, digest, body if with_payload else None


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in `files` (path, size). Digest and size of a response come from the payload read, of a revisit from its header."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], RECORD_NAMES)

        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, local = filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(local) as source:
                    for offset, raw in records_in_range(source, start, min(start + range_bytes, size), size):
                        found = parse_record(raw, with_payload)
                        if found:
                            rows.append((path, offset, *found))
                            held += len(raw)
                        if held > BATCH_BYTES:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    return arrow_map(ranges.repartition(files.sparkSession.sparkContext.defaultParallelism * 4), scan, RECORD_SCHEMA)


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of (page_id, url, html) in a shared folder; returns their (path, size, records).

    Of pages with equal payloads, the one with the smallest page_id is a response and the others are revisits of it; if none
    of them has an id, all are responses. A page with repeated rows is a response each time. A task that is run again writes new
    files; only files of the attempt that counts are listed, and the list is written to the folder before it is used.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload("html").alias("body")).withColumn("sha1", F.sha1("body"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = out = None
        done, path, size, count = [], "", 0, 0
        try:
            for part, bodies in (x for batch in batches for x in text_parts(batch, 2)):
                for page_id, url, body, sha1, first_id in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), bodies, part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    if out is None:
                        path, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        fs, local = filesystem(path)
                        fs.create_dir(local.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(local, compression=None)
                    kind = "response" if first_id is None or page_id == first_id else "revisit"
                    member = warc_record(kind, page_id, url, body, base32_sha1(sha1), first_id)
                    out.write(member)
                    size, count = size + len(member), count + 1
                    if size >= file_bytes:
                        out.close()
                        out = None
                        done.append((path, size, count))
        finally:
            if out is not None:
                out.close()
                done.append((path, size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "size", "records"])

    with passing_tables() as keep:
        # Written, so that Spark can split the join for a payload that very many pages have.
        first = cut(rows.groupBy("sha1").agg(F.min("page_id").alias("first_id")))
        joined = rows.join(first, "sha1").select("page_id", "url", "body", "sha1", "first_id")
        return keep(cut(arrow_map(joined, write, "path string, size long, records long")))


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, from archives written to the shared folder and read back.

    A null html is an empty payload; a null url leaves the target out; null ids come back as null. Repeated rows are a record each: of pages that tie for the
    smallest page_id of a payload, all are responses. A very long html is one record, which the task that owns its start reads to its end. Pages of one
    payload are dealt to several tasks. An empty table gives no rows, other columns are not read.
    """
    files = write_warc(pages, shared_folder(spark))
    number = lambda c: F.when(F.col(c).rlike("^urn:page:-?[0-9]+$"), F.substring(c, 10, 30)).cast("long")
    return read_warc(files, with_payload=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", number("refers_to_id")).alias("refers_to"))
