"""Removal of repeated byte strings by suffix order, built column by column for many documents at once.

1. Anchors. Of the grams inside every string of `length` units, the one with the least hash is its anchor, so equal strings have
   equal anchors at equal places. Two Bloom filters of once- and twice-seen anchors drop those that occur once only. They grow with the data up to
   100 million anchors (20 GB); beyond, they fill up: more fragments are shuffled, and results stay the same.
2. Fragments. What a document's strings with one anchor cover is a fragment of 2 * length - gram units at most. Equal fragments are
   combined before they are shuffled by their anchor's hash.
3. Columns. The fragments of an anchor are a collection of documents that are aligned at it. Each round inserts one symbol of each of
   them, from the right: a stable sort by the symbol makes the order of suffixes (the round's column of the collection's
   Burrows-Wheeler transform) from that of the round before, and range minima make the common prefixes of neighbours. Symbols, orders and
   prefixes go through files that are read and written in sequence. A string whose suffix has a common prefix of `length` with a
   neighbour is repeated.
4. An anchor of more than GROUP_FRAGMENTS distinct fragments is no group for a task: it is split in two by how far before the anchor
   strings begin. Strings of a half have more in common than the anchor, which names smaller groups, each with the part of its fragments that the half's
   strings cover. Halves are split again while they are too large; in the end a group is a single string.
5. Repeated strings become spans of their documents, which are cut out. Equal texts, and equal fragments of one anchor, repeat each other
   wholly: the rounds could only confirm that, so they take part once.

Units are bytes for what is removed. The same steps over words find passages of PASSAGE words and more, which may be shorter than that.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.bloom import filter_bits, holds, may_be_in, twice_seen
from marketloom.llm.text import BYTE_VALUE, SPACE, U64, arrow_map, cut, discard, fold_table, mix, payload, text_parts, windows_of, word_hashes

LENGTH, PASSAGE = 400, 51
#: Fragments that go through the rounds together, and distinct ones of a group at most.
ROUND_FRAGMENTS, GROUP_FRAGMENTS = 8192, 8192


@dataclass(frozen=True)
class Units:
    """What strings are made of (bytes, or words between white space with A-Z lower-cased), how many a string and an anchor have, and bytes of a string at least."""

    length: int
    gram: int
    words: bool
    least_bytes: int

    @staticmethod
    def of_bytes(length: int = LENGTH) -> Units:
        return Units(length, 32, False, length)

    @staticmethod
    def of_words(length: int = PASSAGE) -> Units:
        return Units(length, 8, True, 2 * length - 1)

    @property
    def symbol(self) -> np.dtype:
        return np.dtype(np.uint32 if self.words else np.uint8)

    def split(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the joined rows, each row's number of them, hashes of all grams. A word's symbol is half of its hash."""
        if self.words:
            hashes, first, _, _ = word_hashes(rows, fold_table(SPACE))
            return (hashes >> U64(32)).astype(np.uint32), np.diff(first), windows_of(hashes, self.gram)
        data = np.frombuffer(b"".join(rows), dtype=np.uint8)
        return data, np.array([len(r) for r in rows], dtype=np.int64), kgram_hashes(data, self.gram) if len(data) >= self.gram else np.zeros(0, np.uint64)


def kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k bytes (k a power of two), by doubling."""
    h, step = BYTE_VALUE[data], 1
    factor = 0x9E3779B97F4A7C15
    while step < k:
        h = h[:-step] * U64(factor) + (h[step:] ^ (h[step:] >> U64(29)))
        factor = (factor * 0xD1342543DE82EF95 + 0x6A09E667) % 2**64 | 1
        step *= 2
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def find_anchors(sizes: np.ndarray, grams: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash, place, first and last string's start of every anchor; places are in the row."""
    length, empty = units.length, np.zeros(0, dtype=np.int64)
    if not len(sizes) or sizes.max() < length:
        return empty, np.zeros(0, dtype=np.uint64), empty, empty, empty
    bits = U64(32)  # of the hash count, for slices of any size alike; the first place breaks ties
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(grams >> bits << bits | place, length - units.gram + 1)
    anchor = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    # Only strings inside a document count.
    inside = np.zeros(len(anchor) + 1, dtype=np.int64)
    long = sizes >= length
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, np.minimum(begin + sizes - length + 1, len(anchor))[long], -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    doc = np.searchsorted(begin, start, side="right") - 1
    at = anchor[start]
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    d = doc[first]
    return d, grams[at[first]], at[first] - begin[d], start[first] - begin[d], start[last] - begin[d]


def anchor_hashes(rows: list[bytes], units: Units) -> np.ndarray:
    _, sizes, grams = units.split(rows)
    return find_anchors(sizes, grams, units)[1]


FRAGMENT_SCHEMA = "key long, digest binary, starts array<int>, anchor int, fid binary, fragment binary, near int, far int"
RUN_SCHEMA = "key long, anchor int, fid binary, runs array<struct<start: int, end: int>>"


def fragment_rows(rows: list[tuple[int, bytes, list[int], int, bytes, int, int]]) -> pa.RecordBatch:
    """Rows of FRAGMENT_SCHEMA from all but their digest."""
    key, digest, starts, anchor, fragment, near, far = zip(*rows, strict=True)
    columns = [
        pa.array(key, pa.int64()),
        pa.array(digest, pa.binary()),
        pa.array(starts, pa.list_(pa.int32())),
        pa.array(anchor, pa.int32()),
        pa.array([xxhash.xxh3_128_digest(f) for f in fragment], pa.binary()),
        pa.array(fragment, pa.binary()),
        pa.array(near, pa.int32()),
        pa.array(far, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FRAGMENT_SCHEMA.split(", ")])


def cut_fragments(texts: DataFrame, shared, units: Units) -> DataFrame:
    """The fragments of anchors in the filter. starts: where the fragment begins in its document, several times if that repeats it;
    anchor: where the anchor begins in the fragment; fid: the fragment's digest; near, far: how far before the anchor its strings may begin."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in (x for batch in batches for x in text_parts(batch, 1)):
            digests = part.column(0).to_pylist()
            # Copies in a part have the same fragments: one of them is enough, as copies are counted by themselves.
            own = list({d: i for i, d in enumerate(digests)}.values())
            digests, rows = [digests[i] for i in own], [rows[i] for i in own]
            symbols, sizes, grams = units.split(rows)
            doc, keys, at, first, last = find_anchors(sizes, grams, units)
            if not len(keys):
                continue
            begin = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(holds(shared.value, keys))
            held: dict[tuple[int, int, int, bytes], list[int]] = {}
            for d, key, a, s, e in zip(doc[hit].tolist(), keys[hit].view(np.int64).tolist(), at[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
                fragment = symbols[begin[d] + s : begin[d] + e + units.length].tobytes()
                held.setdefault((d, key, a - s, fragment), []).append(s)
            if held:
                yield fragment_rows([(key, digests[d], starts, anchor, fragment, 0, units.length - units.gram) for (d, key, anchor, fragment), starts in held.items()])

    return arrow_map(texts, extract, FRAGMENT_SCHEMA)


def repeated_columns(group: np.ndarray, fragments: list[np.ndarray], anchors: np.ndarray, units: Units) -> np.ndarray:
    """Which strings of which fragments occur in another fragment of their group: (columns, fragments), column c being the string that
    begins length - gram - c units before the anchor. Groups are numbered in order.

    In memory are a column of symbols and the order and prefixes of one round; all else is in files of the task. Each of the two
    files of a state is written over from its beginning, so nothing is allocated or cut off while rounds go on.
    """
    n, length, left = len(fragments), units.length, units.length - units.gram
    width = left + length
    if units.words:  # numbered in order: only whether symbols are equal counts
        named, ranks = np.unique(np.concatenate(fragments), return_inverse=True)
        fragments, none = np.split(ranks, np.cumsum([len(f) for f in fragments])[:-1]), len(named)
    else:
        none = 256  # no symbol: beyond a fragment's ends, equal to nothing
    kind = np.dtype(np.int32 if units.words else np.uint16)
    wide = np.int64 if (int(group.max(initial=0)) + 1) * (none + 1) >= 1 << 31 else np.int32
    found = np.zeros((left + 1, n), dtype=bool)
    with tempfile.TemporaryDirectory() as folder:
        table = np.memmap(Path(folder) / "symbols", dtype=kind, mode="w+", shape=(width, n))
        block = 1024  # fragments are transposed by blocks, the file has columns in sequence from the right
        for begin in range(0, n, block):
            part = np.full((min(block, n - begin), width), none, dtype=kind)
            for i, (fragment, anchor) in enumerate(zip(fragments[begin : begin + block], anchors[begin : begin + block].tolist(), strict=True)):
                part[i, left - anchor : left - anchor + len(fragment)] = fragment
            table[:, begin : begin + block] = part.T[::-1]
        table.flush()
        del table
        order, prefix, column = np.arange(n, dtype=np.int32), np.zeros(n + 1, dtype=np.int32), np.empty(n, dtype=kind)
        with (Path(folder) / "symbols").open("rb", buffering=0) as source, (Path(folder) / "round0").open("w+b", buffering=0) as even, (Path(folder) / "round1").open("w+b", buffering=0) as odd:
            for c in range(width - 1, -1, -1):
                source.readinto(column.data)
                if c < width - 1:
                    before = odd if c & 1 else even
                    before.seek(0)
                    before.readinto(order.data)
                    before.readinto(prefix.data)
                symbol = column[order]
                sort_key = group[order].astype(wide) * wide(none + 1) + symbol
                move = np.argsort(sort_key, kind="stable")
                after, sorted_key = order[move], sort_key[move]
                same = np.flatnonzero((sorted_key[1:] == sorted_key[:-1]) & (symbol[move[1:]] != none)) + 1
                fresh = np.zeros(n + 1, dtype=np.int32)
                if len(same):
                    low, high = move[same - 1] + 1, move[same] + 1
                    common = prefix[high - 1]
                    far = np.flatnonzero(high > low + 1)
                    if len(far):
                        bounds = np.stack([low[far], high[far]], axis=1).ravel()
                        common[far] = np.minimum.reduceat(prefix, bounds)[::2]
                    fresh[same] = common + 1
                if c <= left:
                    whole = fresh >= length
                    found[c, after] = whole[:n] | whole[1:]
                out = even if c & 1 else odd
                out.seek(0)
                out.write(after.astype(np.int32).data)
                out.write(fresh.data)
    return found


def runs_of_batch(keys: list[int], anchors: list[int], fragments: list[bytes], times: list[int], units: Units) -> Iterator[tuple[int, int, bytes, list[dict[str, int]]]]:
    """(key, anchor, fid, runs) of distinct fragments with repeated strings; rows are whole groups in order of their keys."""
    group = np.unique(np.array(keys, dtype=np.int64), return_inverse=True)[1].astype(np.int32)
    rank = np.flatnonzero(np.bincount(group)[group] > 1)  # a fragment alone in its group needs no rounds
    found: dict[int, np.ndarray] = {}
    if len(rank):
        marks = repeated_columns(group[rank], [np.frombuffer(fragments[i], units.symbol) for i in rank], np.array([anchors[i] for i in rank]), units)
        found = {int(i): marks[:, j] for j, i in enumerate(rank)}
    left = units.length - units.gram
    for i, (key, anchor, fragment, n) in enumerate(zip(keys, anchors, fragments, times, strict=True)):
        strings = len(fragment) // units.symbol.itemsize - units.length + 1
        if n > 1:
            runs = [(0, strings)]
        elif i in found:
            mark = found[i][left - anchor : left - anchor + strings]
            runs = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
        else:
            continue
        if runs:
            yield key, anchor, xxhash.xxh3_128_digest(fragment), [{"start": a, "end": b - 1 + units.length} for a, b in runs]


def repeated_runs(distinct: DataFrame, units: Units) -> DataFrame:
    """The runs of repeated strings in distinct fragments (key, anchor, fragment, times)."""

    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])

        def emit(upto: int) -> Iterator[pa.RecordBatch]:
            rows = list(runs_of_batch(*(c[:upto] for c in held), units))
            for column in held:
                del column[:upto]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "anchor", "fid", "runs"])

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                for column, values in zip(held, batch.slice(start, 1024).columns, strict=True):
                    column += values.to_pylist()
                if len(held[0]) >= ROUND_FRAGMENTS:
                    upto = len(held[0])
                    while upto and held[0][upto - 1] == held[0][-1]:
                        upto -= 1
                    if upto:
                        yield from emit(upto)
        if held[0]:
            yield from emit(len(held[0]))

    dealt = distinct.select("key", "anchor", "fragment", "times").repartition("key").sortWithinPartitions("key")
    return arrow_map(dealt, rounds, RUN_SCHEMA)


def split_fragments(fragments: DataFrame, units: Units) -> DataFrame:
    """Fragments in halves by how far before the anchor strings begin. Equal strings are in the same half and have what its strings have in common, so they meet again."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = units.symbol.itemsize
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                out = []
                for key, digest, starts, anchor, _, fragment, near, far in zip(*(c.to_pylist() for c in batch.slice(begin, 1024).columns), strict=True):
                    middle = (near + far) // 2
                    for a, b in ((near, middle), (middle + 1, far)):
                        first, last = max(0, anchor - b), min(len(fragment) // size - units.length, anchor - a)
                        if first <= last:
                            common = fragment[(anchor - a) * size : (anchor - b + units.length) * size]
                            name = int(U64(xxhash.xxh3_64_intdigest(common, a * units.length + b)).view(np.int64))
                            part = fragment[first * size : (last + units.length) * size]
                            out.append((name, digest, [s + first for s in starts], anchor - first, part, a, b))
                if out:
                    yield fragment_rows(out)

    return arrow_map(fragments, halves, FRAGMENT_SCHEMA)


def bounded_groups(fragments: DataFrame, units: Units) -> tuple[DataFrame, list[DataFrame]]:
    """The fragments (a written table) with groups of GROUP_FRAGMENTS distinct ones at most, and the tables that were written for that."""
    done, written = [], []
    while True:
        open_rows = fragments.where("near < far")  # else a group is one string
        many = cut(open_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_FRAGMENTS).select("key"))
        written.append(many)
        if not many.isEmpty():  # many rows may be few fragments
            distinct = open_rows.join(many, "key").groupBy("key", "anchor", "fid").agg(F.lit(1))
            many = cut(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_FRAGMENTS).select("key"))
            written.append(many)
        if many.isEmpty():
            done.append(fragments)
            return reduce(DataFrame.unionByName, done), written
        done.append(fragments.join(many, "key", "left_anti"))
        fragments = cut(split_fragments(fragments.join(many, "key", "left_semi"), units))
        written.append(fragments)


def repeated_spans(texts: DataFrame, n_bytes: int, units: Units) -> DataFrame:
    """(digest, words, starts, runs), written: unit ranges that repeated strings cover, each run counted from each start. texts: digest, text."""
    texts = texts.where(F.octet_length("text") >= units.least_bytes)
    bits = twice_seen(texts.select("text"), filter_bits(n_bytes * 2 // (units.length * (6 if units.words else 1))), lambda rows: anchor_hashes(rows, units))  # two anchors a string
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    first = cut(cut_fragments(texts, shared, units))
    shared.unpersist()
    fragments, written = bounded_groups(first, units)
    runs = repeated_runs(fragments.groupBy("key", "anchor", "fragment").agg(F.sum(F.size("starts")).alias("times")), units)
    spans = fragments.select("key", "anchor", "fid", "digest", "starts").join(runs, ["key", "anchor", "fid"])
    spans = cut(spans.select("digest", F.lit(units.words).alias("words"), "starts", "runs"))
    for table in (first, *written):
        discard(table)
    return spans


def merge_runs(found: list[dict]) -> list[tuple[int, int]]:
    """Disjoint ranges in order, from starts and runs."""
    if not found:
        return []
    starts = np.concatenate([np.add.outer(x["starts"], [r["start"] for r in x["runs"]]).ravel() for x in found])
    ends = np.concatenate([np.add.outer(x["starts"], [r["end"] for r in x["runs"]]).ravel() for x in found])
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[first].tolist(), reach[np.append(first[1:], len(reach)) - 1].tolist(), strict=True))


def digest_name() -> Column:
    """56 bits of a text's digest."""
    return F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long").alias("name")


DEDUP_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "spans"]
DEDUP_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, spans array<struct<start: int, end: int>>"


def dedup_strings(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, spans) of every row, spans being the maximal removed runs of the UTF-8 text.

    Removed is each byte that a string of `length` bytes covers which starts anywhere else too, in another row or the same. n_passage_words are the
    words (between white space, A-Z lower-cased) that `passage` consecutive words cover which start anywhere else too; they are counted, not removed.
    Null and empty texts lose nothing, nor do texts shorter than `length`. Of equal strings none is kept, so ties need no order; a very long text
    is handled whole, by slices of its anchors. Repeated rows repeat each other's strings. Documents are told apart by row, not by id, so null and
    repeated ids need no care; an empty table gives none, other columns are not read.
    """
    units = [Units.of_bytes(length), Units.of_words(passage)]
    if any(u.length <= u.gram for u in units):
        raise ValueError(f"length is at least {units[0].gram + 1}, passage {units[1].gram + 1}")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), payload().alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    n_bytes = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = [repeated_spans(texts.select("digest", "text"), n_bytes, u) for u in units]
    least = min(u.least_bytes for u in units)
    copies = cut(texts.where(F.octet_length("text") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest"))
    # Copies lose everything, so their spans, once for each of them, are left out before any gathering.
    spans = parts[0].unionByName(parts[1]).join(copies, "digest", "left_anti").groupBy("digest").agg(F.collect_list(F.struct("words", "starts", "runs")).alias("spans"))
    removed = spans.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)), allowMissingColumns=True)
    # Written, so that Spark can split the join for a text of very many copies; texts that lose nothing aren't shuffled to it.
    removed = cut(removed.withColumn("name", digest_name()))
    for table in (*parts, copies):
        discard(table)
    texts = texts.withColumn("name", digest_name())
    may = may_be_in("name", removed)
    some = texts.where(may).join(removed.select(F.col("digest").alias("__digest"), "spans", "copied"), F.col("digest") == F.col("__digest"), "left")
    rest = texts.where(~may).select("doc_id", "text", F.lit(None).cast(removed.schema["spans"].dataType).alias("spans"), F.lit(False).alias("copied"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in (x for batch in batches for x in text_parts(batch, 1)):
            out = []
            for doc_id, text, found, copied in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if copied:
                    runs, words = [(0, len(text))] if len(text) >= length else [], len(text.split())
                    words = words if words >= passage else 0
                else:
                    runs = merge_runs([x for x in found or [] if not x["words"]])
                    words = sum(b - a for a, b in merge_runs([x for x in found or [] if x["words"]]))
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((doc_id, len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), words, [{"start": a, "end": b} for a, b in runs]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], DEDUP_NAMES)

    # Written here, in small batches, as its rows have no texts.
    out = cut(arrow_map(some.select("doc_id", "text", "spans", "copied").unionByName(rest), remove, DEDUP_SCHEMA))
    discard(removed)
    return out
