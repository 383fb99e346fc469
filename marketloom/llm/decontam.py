"""Benchmark decontamination: an FM-index of each training shard, searched backward for the benchmark's word windows.

A shard's text is the sequence of its documents' words as symbols of those of its words that any window of the benchmark has. Stretches of words that are
too short to hold a window, or are in no window, become one separator, as no window can lie in them. The index has
a wavelet matrix of the Burrows-Wheeler transform and sampled suffix positions, nothing else of the text.

The benchmark's windows are cut by tasks, made distinct by a shuffle and written to the shared folder in blocks of bounded size. A task reads
the vocabularies of all blocks, one after the other, to mark its words, builds each shard's index once, and searches it for one block after the
other, so nothing of the benchmark is broadcast or passes through the driver, and more blocks are more searches but no more suffix sorting.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.text import NOT_ALNUM, arrow_map, cut, filesystem, fold_table, folded, free_names, packed_rows, passing_tables, payload, quoted, shared_folder, text_parts, unpacked, word_hashes

WINDOW = 10
#: Bytes of texts in a shard's index, and of texts that are searched for a block together; suffixes between two samples.
SHARD_BYTES, HOLD_BYTES, SAMPLE_EVERY = 1 << 20, 8 << 20, 8
#: Rows (window, item) of a block.
BLOCK_WINDOWS = 100_000
END, GAP = 0, 1


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by prefix doubling; the text ends with the least symbol, which occurs nowhere else."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        ranked = np.zeros(n, dtype=np.int64)
        ranked[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        rank[order] = ranked
        step *= 2
        if ranked[-1] == n - 1 or step > 2 * n:
            return order


class BitRank:
    """Packed bits with the number of ones before every 64 of them."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        if len(bits) < 1 << 31:
            self.before = self.before.astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Symbols by bits, from the highest: rank and access in one step a bit, for many positions at once."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.bits = max(1, (n_symbols - 1).bit_length())
        self.ones: list[BitRank] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            self.ones.append(BitRank(bit))
            self.zeros.append(len(symbols) - int(bit.sum(dtype=np.int64)))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start, end = np.zeros_like(at), at
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            before, until = ones.rank(start), ones.rank(end)
            start = np.where(one, zeros + before, start - before)
            end = np.where(one, zeros + until, end - until)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        symbol, start, end = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones.bit(end)
            symbol = symbol << 1 | one
            before, until = ones.rank(start), ones.rank(end)
            start = np.where(one, zeros + before, start - before)
            end = np.where(one, zeros + until, end - until)
        return symbol, end - start


class FMIndex:
    """Counts and locates windows of symbols in a text that ends with END."""

    def __init__(self, text: np.ndarray, n_symbols: int) -> None:
        order = suffix_order(text)
        self.n = len(text)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))]).astype(np.int64)
        self.tree = WaveletMatrix(text[order - 1], n_symbols)
        sampled = order % SAMPLE_EVERY == 0
        self.marked = BitRank(sampled.astype(np.uint8))
        self.samples = order[sampled]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of each window, from its last symbol backward. windows: a row each, aligned left."""
        low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), self.n, dtype=np.int64)
        for k in range(windows.shape[1] - 1, -1, -1):
            on = np.flatnonzero((lengths > k) & (low < high))
            if len(on):
                symbol = windows[on, k]
                low[on] = self.less[symbol] + self.tree.rank(symbol, low[on])
                high[on] = self.less[symbol] + self.tree.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows start: steps back to the next sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        while True:
            walking = np.flatnonzero(~self.marked.bit(at))
            if not len(walking):
                return self.samples[self.marked.rank(at)] + steps
            symbol, before = self.tree.access(at[walking])
            at[walking] = self.less[symbol] + before
            steps[walking] += 1


@dataclass
class Phrases:
    """The benchmark's distinct windows as symbols and as words, and the items that have each."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]
    words: list[bytes]

    @property
    def shortest(self) -> int:
        return int(self.lengths.min(initial=2**31))

    @staticmethod
    def of(rows: list[tuple[bytes, str | None]], width: int) -> Phrases:
        """Of (window, item) rows, a window being its words with blanks between. Symbols are hashes of words, so windows of other words may have the same."""
        owners: dict[bytes, list[str]] = {}
        for window, item in rows:
            held = owners.setdefault(window, [])
            if item is not None:
                held.append(item)
        hashes, first, _, _ = word_hashes(list(owners), fold_table(NOT_ALNUM))
        lengths = np.diff(first)
        vocabulary, symbol = np.unique(hashes, return_inverse=True)
        windows = np.full((len(owners), width), END, dtype=np.int64)
        windows[np.arange(width) < lengths[:, None]] = symbol + 2
        return Phrases(vocabulary, windows, lengths, [sorted(x) for x in owners.values()], list(owners))


def shard_text(hashes: np.ndarray, first: np.ndarray, known: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a shard's known words, with a separator between stretches; the word that each symbol is; the hash of each symbol from 2 on.

    Stretches of fewer than `shortest` known words are left out, as no window fits into them.
    """
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    inner = first[(first > 0) & (first < len(hashes))]
    begins[inner] = known[inner]  # a stretch ends with its document
    starts = np.flatnonzero(begins)
    stretch = np.cumsum(begins) - 1
    lengths = np.bincount(stretch[known], minlength=len(starts))
    keep = known & (lengths[np.maximum(0, stretch)] >= shortest) if len(starts) else known
    words = np.flatnonzero(keep)
    fresh = begins[words]
    place = np.arange(len(words)) + np.cumsum(fresh)  # a separator before each stretch
    n = len(words) + int(fresh.sum())
    text, word = np.full(n + 2, GAP, dtype=np.int64), np.full(n + 2, -1, dtype=np.int64)
    vocabulary, symbol = np.unique(hashes[words], return_inverse=True)
    text[place], word[place] = symbol + 2, words
    text[-1] = END
    return text, word, vocabulary


class Blocks:
    """Blocks of phrases in memory."""

    def __init__(self, blocks: list[Phrases]) -> None:
        self.blocks = blocks

    def vocabularies(self) -> Iterator[tuple[np.ndarray, int]]:
        """Of each block the vocabulary and the number of words of its shortest window."""
        return ((b.vocabulary, b.shortest) for b in self.blocks)

    def __iter__(self) -> Iterator[Phrases]:
        return iter(self.blocks)


class BlockFiles(Blocks):
    """Blocks in files, read one after the other; a single one is read once a task."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths
        super().__init__([])

    def read(self, path: str, whole: bool) -> Phrases:
        """A block, or no more than its vocabulary and its shortest window."""
        fs, local = filesystem(path)
        with fs.open_input_file(local) as source:
            size, shortest = np.frombuffer(source.read(16), np.int64).tolist()
            vocabulary = np.frombuffer(source.read(8 * size), np.uint64)
            return Phrases(vocabulary, *pickle.loads(source.read())) if whole else Phrases(vocabulary, np.zeros((0, 0), np.int64), np.array([shortest]), [], [])

    def vocabularies(self) -> Iterator[tuple[np.ndarray, int]]:
        if len(self.paths) == 1:
            return ((b.vocabulary, b.shortest) for b in self)
        return ((b.vocabulary, b.shortest) for b in (self.read(p, False) for p in self.paths))

    def __iter__(self) -> Iterator[Phrases]:
        if len(self.paths) == 1:
            self.blocks = self.blocks or [self.read(self.paths[0], True)]
            return iter(self.blocks)
        return (self.read(p, True) for p in self.paths)


class Shard:
    """Texts that are searched together: which of their words are hit, by which items. First all blocks are met, then the index is built, then all blocks are searched."""

    def __init__(self, rows: list[bytes]) -> None:
        self.rows = rows
        self.hashes, self.first, self.starts, self.ends = word_hashes(rows, fold_table(NOT_ALNUM))
        self.text = folded(rows, fold_table(NOT_ALNUM))
        self.known, self.covered = np.zeros(len(self.hashes), dtype=bool), np.zeros(len(self.hashes), dtype=bool)
        self.items: dict[int, set[str]] = {}
        self.index: FMIndex | None = None

    def meet(self, vocabulary: np.ndarray) -> None:
        """Marks the words that a block's windows have."""
        if len(vocabulary):
            self.known |= vocabulary[np.minimum(np.searchsorted(vocabulary, self.hashes), len(vocabulary) - 1)] == self.hashes

    def build(self, shortest: int) -> None:
        """The index of the marked words, for windows of `shortest` words and more."""
        text, self.word, self.vocabulary = shard_text(self.hashes, self.first, self.known, shortest)
        if len(text) > 2:
            self.index = FMIndex(text, len(self.vocabulary) + 2)

    def symbols(self, phrases: Phrases) -> np.ndarray:
        """The block's windows in the shard's symbols, -1 where the shard doesn't have a word."""
        at = np.minimum(np.searchsorted(self.vocabulary, phrases.vocabulary), len(self.vocabulary) - 1)
        return np.concatenate([[END, GAP], np.where(self.vocabulary[at] == phrases.vocabulary, at + 2, -1)])[phrases.windows]

    def search(self, phrases: Phrases) -> None:
        """Adds what the index has of the block. The texts stay as they are, so the order of blocks doesn't count."""
        if self.index is None:
            return
        windows = self.symbols(phrases)
        asked = np.flatnonzero((windows >= 0).all(axis=1))
        low, high = self.index.search(windows[asked], phrases.lengths[asked])
        found = np.flatnonzero(high > low)
        if not len(found):
            return
        counts = (high - low)[found]
        row = np.repeat(low[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        which = np.repeat(asked[found], counts)
        at = self.word[self.index.locate(row)]
        same = np.fromiter((self.has(a, phrases.words[w], n) for a, w, n in zip(at.tolist(), which.tolist(), phrases.lengths[which].tolist(), strict=True)), bool, len(at))
        at, which = at[same], which[same]
        hit = np.zeros(len(self.hashes) + 1, dtype=np.int32)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + phrases.lengths[which], -1)
        self.covered |= np.cumsum(hit[:-1]) > 0
        owner = np.searchsorted(self.first[:-1], at, side="right") - 1
        for doc, window in np.unique(np.stack([owner, which]), axis=1).T.tolist():
            self.items.setdefault(doc, set()).update(phrases.items[window])

    def has(self, at: int, words: bytes, n: int) -> bool:
        """Whether the n words from one on are these, letter by letter: a hit so far is one of hashes."""
        return self.text[self.starts[at] : self.ends[at + n - 1]].split() == words.split()

    def found(self) -> Iterator[tuple[int, int, list[str], list[tuple[int, int]]]]:
        """Of each text: number of words, of hit words, items found, merged byte spans that hold hits."""
        begin = np.cumsum([0, *(len(r) + 1 for r in self.rows)])
        for i in range(len(self.rows)):
            a, b = int(self.first[i]), int(self.first[i + 1])
            edges = np.flatnonzero(np.diff(np.concatenate([[0], self.covered[a:b].astype(np.int8), [0]])))
            spans = [(int(self.starts[a + s] - begin[i]), int(self.ends[a + e - 1] - begin[i])) for s, e in edges.reshape(-1, 2)]
            yield b - a, int(self.covered[a:b].sum()), sorted(self.items.get(i, ())), spans


def find_hits(texts: list[bytes], blocks: Blocks) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """What Shard.found gives, of each text; each block is there twice for all of them, first with its vocabulary alone."""
    shards, part, size = [], [], 0
    for text in texts:
        if part and size + len(text) > SHARD_BYTES:
            shards.append(Shard(part))
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        shards.append(Shard(part))
    shortest = []
    for vocabulary, least in blocks.vocabularies():
        shortest.append(least)
        for shard in shards:
            shard.meet(vocabulary)
    for shard in shards:
        shard.build(min(shortest, default=1))
    for phrases in blocks:
        for shard in shards:
            shard.search(phrases)
    return [x for shard in shards for x in shard.found()]


def item_windows(text: bytes, width: int) -> set[bytes]:
    """The distinct windows of an item, each as its words with blanks between."""
    words = folded([text], fold_table(NOT_ALNUM)).split()
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def phrase_blocks(benchmark: DataFrame, width: int = WINDOW) -> list[str]:
    """Files in the shared folder, each with the Phrases of some BLOCK_WINDOWS distinct rows (window, item).

    A row's block is drawn by both, so a window of very many items is in several blocks. A task that is run again writes other files; only those of the
    attempt that counts are listed.
    """
    folder = shared_folder(benchmark.sparkSession)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch, 1):
                for item, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    found = list(item_windows(text, width))
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], ["window", "item"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, str | None]] = []

        def put() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.phrases"
            fs, local = filesystem(path)
            fs.create_dir(local.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(local, compression=None) as out:
                found = Phrases.of([(w, i) for _, w, i in held], width)
                out.write(np.array([len(found.vocabulary), found.shortest], np.int64).tobytes() + found.vocabulary.tobytes())
                out.write(pickle.dumps((found.windows, found.lengths, found.items, found.words)))
            return pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield put()
                    held = []
                held.append(row)
        if held:
            yield put()

    given = benchmark.select(F.col("item_id").cast("string").alias("item"), payload().alias("text"))
    with passing_tables():
        rows = cut(arrow_map(given, windows, "window binary, item string").distinct())
        blocks = max(1, -(-rows.count() // BLOCK_WINDOWS))
        dealt = rows.select(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)).alias("block"), "window", "item").repartition(blocks, "block").sortWithinPartitions("block", "window", "item")
        return sorted(r["path"] for r in cut(arrow_map(dealt, write, "path string")).collect())  # a name for each block


HITS_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


def search_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every row; spans are merged byte ranges of hit words in the UTF-8 text.

    A window is `width` consecutive words of an item, or all words of a shorter one. Null and empty texts have no words; null
    items have no windows, items without an id only hit. Repeated items count once, repeated rows and null ids of documents
    give a row each. A very long text is a shard of its own; items that tie for a window are all found. An empty benchmark hits
    nothing, an empty table gives no rows, other columns are not read. Of the documents nothing shuffles: every shard is searched where its texts are read.
    """
    paths = phrase_blocks(benchmark, width)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, blocks = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), BlockFiles(paths)
        for batch in batches:
            for part, rows in text_parts(batch, 1, HOLD_BYTES):
                found = find_hits(rows, blocks)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([n for n, _, _, _ in found], pa.int64()),
                        pa.array([hit for _, hit, _, _ in found], pa.int64()),
                        pa.array([items for _, _, items, _ in found], pa.list_(pa.string())),
                        pa.array([[{"start": a, "end": b} for a, b in spans] for _, _, _, spans in found], kind),
                    ],
                    ["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), payload().alias("text")), search, HITS_SCHEMA)


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these merged spans; a blank stands for each, so that words on both sides don't join."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b" ".join([*parts, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents, all columns kept, with hit words cut out of their texts, and __n_cut (as free_names has it), the number of words cut.

    All blocks of the benchmark are searched in the same text before it is cut; that is repeated while what is left holds a window again. Null
    texts stay null, documents without hits stay as they are; null ids and repeated rows need no care, a very long text is a shard of its own, an
    empty table stays empty, an empty benchmark cuts nothing. Of the documents nothing shuffles.
    """
    paths = phrase_blocks(benchmark, width)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = BlockFiles(paths)
        for batch in batches:
            for part, texts in text_parts(batch, 0, HOLD_BYTES):
                dropped, todo = [0] * len(texts), [i for i, t in enumerate(texts) if t]
                while todo:
                    changed = []
                    for i, (_, hit, _, spans) in zip(todo, find_hits([texts[i] for i in todo], blocks), strict=True):
                        if spans:
                            texts[i] = remove_spans(texts[i], spans)
                            dropped[i] += hit
                            changed.append(i)
                    todo = changed
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary(), mask=null), pa.array(dropped, pa.int64()), part.column(1)], ["__text", "__n_cut", "__row"])

    row, field = packed_rows(docs)
    schema = T.StructType().add("__text", "binary").add("__n_cut", "long").add(field)
    return unpacked(arrow_map(docs.select(quoted("text").cast("binary").alias("__text"), row), search, schema), docs.columns, F.col("__n_cut").alias(free_names(docs, "__n_cut")[0]))


def digest_hits(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
