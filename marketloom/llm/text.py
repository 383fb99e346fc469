"""Helpers shared by the corpus operators: Arrow batches of texts, vectorised word hashing, bounded samples, shared folders."""

from __future__ import annotations

import ctypes
import gc
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text that are hashed together; a longer document is hashed alone.
SLICE_BYTES = 1 << 19
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
WORD_FACTORS = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | U64(1)


def payload(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def rows_of(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.to_pylist()]


def parts_of(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `limit` bytes of this column each."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64)))
    start = 0
    while start < len(batch):
        begun = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, begun + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_parts(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive parts of a batch with about `limit` bytes of text each, and their texts (null as empty): only a part's texts are Python objects."""
    for part in parts_of(batch, column, limit):
        yield part, rows_of(part.column(column))


def joined_values(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of all values of a binary column without nulls, one value after the other, where Arrow has them."""
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, kind)
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[1]].view(kind)


#: Rows of a batch that goes to a Python worker while an operator writes a table of its own, where the session has Spark's default: 10,000 texts take more of an executor.
BATCH_ROWS, DEFAULT_BATCH_ROWS, BATCH_SETTING = 2000, "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH_ROWS rows for what is written inside; afterwards the session is as it was."""
    before = spark.conf.get(BATCH_SETTING)
    if before != DEFAULT_BATCH_ROWS:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


#: Bytes of batches from which a task gives memory back.
GIVE_BACK_BYTES = 1 << 20


def give_back() -> None:
    """Memory that this process has freed goes back to the system. Workers are used again: without this they keep the most that any task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, frugal: bool = False) -> DataFrame:
    """mapInArrow, whose workers give their memory back when a task of GIVE_BACK_BYTES or more ends: that takes 40 ms, more than small tasks do, and is left out for work that is frugal: a few MB at once. Batches are as large as the session has them (10,000 rows and 64 MB by Spark's default), smaller in what `cut` writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal read
            for batch in batches:
                read += batch.nbytes
                yield batch

        try:
            yield from work(counted())
        finally:
            if read >= GIVE_BACK_BYTES and not frugal:
                give_back()

    return df.mapInArrow(run, schema)


def quoted(name: str) -> Column:
    """A column by its plain name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of the columns'."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def packed_rows(docs: DataFrame, leave: str | None = "text") -> tuple[Column, T.StructField]:
    """All columns but `leave` as one struct __row, which travels through a worker as it is, and its field in a schema. Its fields go by number, so no name can clash."""
    others = [f for f in docs.schema.fields if f.name != leave]
    row = F.struct(F.lit(0).alias("one"), *(quoted(f.name).alias(f"c{k}") for k, f in enumerate(others))).alias("__row")
    return row, T.StructField("__row", T.StructType([T.StructField("one", T.IntegerType()), *(T.StructField(f"c{k}", f.dataType) for k, f in enumerate(others))]))


def unpacked(out: DataFrame, columns: list[str], *more: Column, leave: str | None = "text") -> DataFrame:
    """The columns in their order from __row and __text, then `more`."""
    place = {c: k for k, c in enumerate(c for c in columns if c != leave)}
    return out.select(*(F.col("__text").cast("string").alias(c) if c == leave else F.col("__row").getField(f"c{place[c]}").alias(c) for c in columns), *more)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def fold_table(separators: bytes) -> bytes:
    """A table for bytes.translate: A-Z lower-cased, separators as blanks."""
    table = bytearray(range(256))
    table[65:91] = range(97, 123)
    for c in separators:
        table[c] = 0x20
    return bytes(table)


def folded(rows: list[bytes], table: bytes) -> bytes:
    """The rows by the table, a blank after each."""
    return (b" ".join(rows) + b" ").translate(table)


#: Separators of words: ASCII white space, and every ASCII byte but letters and digits.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


#: Words that are Python objects at once.
WORD_SLICE = 1 << 16


def word_hashes(rows: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes (xxh3) of all words of the rows in order; the first word of each row and of a row beyond the last; starts and ends of words in the joined rows."""
    text = folded(rows, table)
    word = np.frombuffer(text, dtype=np.uint8) != 0x20
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    hashes = np.empty(len(starts), dtype=np.uint64)
    for k in range(0, len(starts), WORD_SLICE):
        last = min(k + WORD_SLICE, len(starts))
        hashes[k:last] = np.fromiter(map(xxhash.xxh3_64_intdigest, text[starts[k] : ends[last - 1]].split()), np.uint64, last - k)
    begin = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in rows], out=begin[1:])
    return hashes, np.searchsorted(starts, begin), starts, ends


def windows_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive words; the last width - 1 positions have none."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, U64(width))
    for k in range(width):
        out += hashes[k : k + n] * WORD_FACTORS[k]
    return mix(out)


def short_hash(hashes: np.ndarray) -> np.uint64:
    """The hash of a sequence that is shorter than a window."""
    return mix(np.array([U64(len(hashes)) + np.sum(hashes * WORD_FACTORS[: len(hashes)], dtype=np.uint64)], dtype=np.uint64))[0]


def sample_bounds(rows: DataFrame, group: str, k: int) -> dict[str | None, int]:
    """Of each group a bound so that about k of its rows have a uniform 64-bit hash at most as high. A number a group is gathered, nothing is sorted."""
    return {r[group]: min(2**63 - 1, int(-(2**63) + min(1.0, k / r["count"]) * 2.0**64)) for r in rows.groupBy(group).count().collect()}


def in_sample(group: str, order: Column, bounds: dict[str | None, int]) -> Column:
    """Whether a row is in the sample of its group: `order` is a hash of what tells rows apart, so that equal rows are in or out together."""
    named = [x for name, bound in bounds.items() if name is not None for x in (F.lit(name), F.lit(bound).cast("long"))]
    bound = F.try_element_at(F.create_map(*named), F.coalesce(F.col(group), F.lit(""))) if named else F.lit(None).cast("long")
    bound = F.when(F.col(group).isNull(), F.lit(bounds.get(None)).cast("long")).otherwise(bound)
    return F.coalesce(order <= bound, F.lit(False))


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcasts an object with its class, which executors need not have installed; the function returns it in a task."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or in a temporary one where that is unset, as in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "marketloom-checkpoints")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_PASSING: ContextVar[list[DataFrame] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `cut` writes inside are deleted at the end, but for those that are handed to the function it gives; these are written in the block around, if there is one."""
    written: list[DataFrame] = []
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.cut_path)
        return table

    before = _PASSING.set(written)
    try:
        yield keep
    finally:
        _PASSING.reset(before)
        around = _PASSING.get()
        for table in written:
            if table.cut_path not in kept:
                discard(table)
            elif around is not None:
                around.append(table)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written as Parquet to the shared folder and read again."""
    path = shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    passing = _PASSING.get()
    if passing is not None:
        passing.append(out)
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that `shared_folder` named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes what `cut` wrote for this frame, when nothing will read it any more."""
    remove(df.sparkSession, df.cut_path)


def filesystem(uri: str):
    """pyarrow's file system for a shared folder's address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))
