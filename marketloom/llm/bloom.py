"""Two Bloom filters, of once-seen and twice-seen hashes, built by tasks and merged chunk by chunk.

A task puts hashes into the first filter, and those that it holds already, or sees twice at a time, into the second. Filters of tasks merge
as once = OR; twice = OR, plus each bit that is set in two once-filters. A hash in two tasks has all its bits there, so no
repeat is missed; a full filter only lets more hashes pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.text import U64, arrow_map, give_back, mix, text_parts

#: Filters grow with the data, by ten bits a hash, up to this bound of what is broadcast (2**30 bits are 128 MB, for 100 million hashes);
#: a task that builds has two of them.
MAX_BITS, CHUNK_BITS, N_HASHES = 1 << 30, 1 << 19, 3
CHUNK_BYTES = CHUNK_BITS // 8


def filter_bits(n_hashes: int) -> int:
    """A power of two, at least ten bits for each hash, within MAX_BITS."""
    return min(MAX_BITS, max(CHUNK_BITS, 1 << (max(1, 10 * n_hashes) - 1).bit_length()))


def places(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and masks of N_HASHES bits for each 64-bit hash, by double hashing."""
    a, b = hashes & U64(0xFFFFFFFF), (hashes >> U64(32)) | U64(1)
    at = np.stack([(a + U64(k) * b + U64(k * k)) & U64(n_bits - 1) for k in range(N_HASHES)])
    return (at >> U64(3)).astype(np.int64), U64(1).astype(np.uint8) << (at & U64(7)).astype(np.uint8)


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a filter."""
    byte, mask = places(hashes, 8 * len(bits))
    return ((bits[byte] & mask) != 0).all(axis=0)


def add(bits: np.ndarray, hashes: np.ndarray) -> None:
    byte, mask = places(hashes, 8 * len(bits))
    np.bitwise_or.at(bits, byte.ravel(), mask.ravel())


def seen_filter(texts: DataFrame, n_bits: int, hashes_of: Callable[[list[bytes]], np.ndarray], twice: bool = True) -> np.ndarray:
    """The filter, as bytes, of hashes that may occur twice, or (twice: false) of all. texts: one column; hashes_of gives the hashes of some texts, repeats included."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(n_bits // 8, dtype=np.uint8), np.zeros(n_bits // 8, dtype=np.uint8)
        for batch in batches:
            for _, rows in text_parts(batch, 0):
                found, counts = np.unique(hashes_of(rows), return_counts=True)
                if len(found):
                    add(again, found[(counts > 1) | holds(once, found)])
                    add(once, found)
        for i in range(n_bits // CHUNK_BITS):
            a, b = (x[i * CHUNK_BYTES : (i + 1) * CHUNK_BYTES] for x in (once, again))
            if a.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "once": [a.tobytes()], "twice": [b.tobytes()]})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for chunk, once, again in frame.itertuples(index=False):
                a, b = np.frombuffer(once, np.uint8), np.frombuffer(again, np.uint8)
                old = held.get(chunk)
                held[chunk] = (a, b) if old is None else (old[0] | a, old[1] | b | (old[0] & a))
        yield pd.DataFrame({"chunk": list(held), "bits": [x[twice].tobytes() for x in held.values()]})
        held.clear()
        give_back()

    parts = arrow_map(texts, build, "chunk int, once binary, twice binary")
    merged = parts.repartition(max(1, n_bits // CHUNK_BITS // 8), "chunk").mapInPandas(merge, "chunk int, bits binary")
    out = np.zeros((n_bits // CHUNK_BITS, CHUNK_BYTES), dtype=np.uint8)
    for row in merged.toLocalIterator():  # of bounded size: n_bits in all
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def twice_seen(texts: DataFrame, n_bits: int, hashes_of: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
    """The filter, as bytes, of hashes that may occur twice."""
    return seen_filter(texts, n_bits, hashes_of)


def may_be_in(column: str, keys: DataFrame) -> Column:
    """Whether a long column's value may be in keys (a written table of that column), never false for one that is: what isn't needs no shuffle."""
    hashes_of = lambda parts: mix(np.frombuffer(b"".join(parts), ">u8").astype(np.uint64))
    found = seen_filter(keys.select(F.unhex(F.lpad(F.hex(column), 16, "0"))), filter_bits(keys.count()), hashes_of, False)
    shared = keys.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def may(key: pd.Series) -> pd.Series:
        return key.notna() & holds(shared.value, mix(key.fillna(0).to_numpy(np.int64).view(np.uint64)))

    return may(column)
