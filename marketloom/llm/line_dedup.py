"""Line deduplication: two Bloom filters find suspected repeats, only those shuffle for exact confirmation.

1. Tasks build two filters of their lines' hashes, once-seen and twice-seen, which are merged (see bloom). Beyond 100 million lines they
   fill up: more lines are suspected and shuffled, and results stay the same.
2. Lines whose hash is in the merged twice-filter are suspected: (digest of the key, document) is shuffled, once for
   each document. Counting confirms repeats exactly and finds the document that keeps the line. Counts combine before they are shuffled
   and are written before they are joined, so that Spark can split the join for a line that a third of all documents hold.
3. Documents that lose lines are rewritten; the others pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.bloom import filter_bits, holds, may_be_in, twice_seen
from marketloom.llm.text import arrow_map, cut, free_names, packed_rows, passing_tables, payload, quoted, text_parts, unpacked

STRIP = bytes([0x20, *range(0x09, 0x0E)])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A line's key, or None if that has fewer than min_chars code points."""
    key = line.strip(STRIP)
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()  # bytes: A-Z only


def line_keys(text: bytes, min_chars: int) -> list[bytes]:
    """The distinct keys of a text."""
    return list({k for k in (line_key(x, min_chars) for x in text.split(b"\n")) if k is not None})


def line_hashes(texts: list[bytes], min_chars: int) -> np.ndarray:
    """Hashes of the keys of some texts, once a text."""
    return np.array([xxhash.xxh3_64_intdigest(k) for text in texts for k in line_keys(text, min_chars)], dtype=np.uint64)


def plan_line_drops(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, digests): the keys that each document loses, as 16-byte digests joined together."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), payload().alias("text")).where("doc_id is not null")
    n_lines = texts.select((F.sum(F.octet_length("text") - F.octet_length(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))) + 1)).alias("n")).first()["n"] or 0
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(texts.select("text"), filter_bits(int(n_lines)), lambda rows: line_hashes(rows, min_chars)))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in text_parts(batch, 1):
                keys = [(doc_id, k) for doc_id, text in zip(part.column(0).to_pylist(), rows, strict=True) for k in line_keys(text, min_chars)]
                hit = holds(shared.value, np.array([xxhash.xxh3_64_intdigest(k) for _, k in keys], dtype=np.uint64))
                found = [keys[i] for i in np.flatnonzero(hit).tolist()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([xxhash.xxh3_128_digest(k) for _, k in found], pa.binary())], ["doc_id", "digest"])

    with passing_tables() as keep:
        # A document and line once, dealt by both: repeated rows of a document count as one.
        held = cut(arrow_map(texts, suspect, "doc_id long, digest binary").distinct())
        shared.unpersist()
        repeated = held.groupBy("digest").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
        lost = held.join(cut(repeated.select("digest", "keeper")), "digest").where("doc_id < keeper")
        return keep(cut(lost.groupBy("doc_id").agg(F.array_join(F.collect_list(F.hex("digest")), "").alias("digests"))))  # a document's own lines


def drop_lines(text: bytes, digests: set[bytes], min_chars: int) -> tuple[list[bytes], int]:
    """The lines that stay, and the number of all."""
    lines = text.split(b"\n")
    keep = []
    for line in lines:
        key = line_key(line, min_chars) if digests else None
        if key is None or xxhash.xxh3_128_digest(key) not in digests:
            keep.append(line)
    return keep, len(lines)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The documents, all columns kept, without the lines that min_docs documents or more share, except in the largest doc_id.

    Adds __n_lines, __n_dropped and __kept_sha256 (as free_names has them, where such columns are there). Null and empty texts are one empty line; a null text that loses
    nothing stays null. A very long text or line is handled whole, by the worker that reads it. Rows with a null doc_id are not counted as
    documents and stay as they are. Repeated rows of a doc_id count as one document and all lose the same lines; as ids differ
    otherwise, there are no ties for the largest. Extra columns pass through. Empty tables give empty tables.
    """
    drops = plan_line_drops(docs, min_chars, min_docs)
    row, field = packed_rows(docs)  # the row travels with its text, so no second join is needed
    given = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("binary").alias("text"), row)
    # Only documents that may lose lines are shuffled; what the filter lets through besides joins nothing.
    may = may_be_in("doc_id", drops)
    some = given.where(may).join(drops, "doc_id", "left").select("text", "digests", "__row")
    rest = given.where(~may).select("text", F.lit(None).cast("string").alias("digests"), "__row")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in text_parts(batch, 0):
                texts, lines, dropped, digest = [], [], [], []
                for text, null, held in zip(rows, part.column(0).is_null().to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = bytes.fromhex(held or "")
                    keep, n = drop_lines(text, {raw[i : i + 16] for i in range(0, len(raw), 16)}, min_chars)
                    joined_text = b"\n".join(keep)
                    texts.append(None if null else joined_text)
                    lines.append(n)
                    dropped.append(n - len(keep))
                    digest.append(hashlib.sha256(joined_text).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest, pa.string()), part.column(2)], schema.names)

    schema = T.StructType().add("__text", "binary").add("__n_lines", "long").add("__n_dropped", "long").add("__kept_sha256", "string").add(field)
    found = ["__n_lines", "__n_dropped", "__kept_sha256"]
    names = zip(found, free_names(docs, *found), strict=True)
    return unpacked(arrow_map(some.unionByName(rest), rewrite, schema), docs.columns, *(F.col(c).alias(name) for c, name in names))
