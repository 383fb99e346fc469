"""Ranked lexical search: hierarchical max trees over document ranges of each term, searched best-first.

1. The distinct terms of the items are written; blocks of items are taken one after the other, each with a vocabulary of bounded size.
2. Index. Tasks cut documents into shards of some SHARD_BYTES of text and write, a row a shard, the postings of the block's terms:
   document, count. Within a shard documents are ordered by length, so that a range holds documents of like weight. Numbers of documents,
   of their terms and of documents that hold a term are summed up over all shards.
3. Trees. Over a shard's documents, ranges of LEAF and of FANOUT ranges each hold the greatest part of a score that each term gives to any document of theirs.
4. Search. For an item, a range's bound is the sum of its terms' maxima. The range with the highest bound is opened next: its parts get their
   bounds, or, at the end, its documents their exact scores. A task's search of an item ends when no bound is as high as the k-th score
   it has found in any of its shards; ranges whose bound equals that are opened, as a document of a smaller id may tie.
5. Each task gives k rows an item at most, which are merged by a ranking that Spark limits before its shuffle.

Scores are 64-bit integers, so the result is the same however documents are dealt. Items of one id are one item with all their
terms; an item without terms has no rows. Repeated documents are documents of their own; those with a null id come last among equals. Null and
empty texts have no terms and don't count; a very long text is cut into words piece by piece and is in one shard. Empty tables give no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.text import arrow_map, cut, passing_tables, payload, rows_of, share

#: Text and documents of a shard; documents of the lowest ranges, ranges of a higher one; bytes of the distinct terms of a block of items.
SHARD_BYTES, SHARD_DOCS, LEAF, FANOUT, BLOCK_BYTES = 4 << 20, 4096, 64, 8, 1 << 20
#: A long text is cut into pieces of about so many bytes.
PIECE_BYTES = 1 << 20
#: What a term is made of; in texts as UTF-8 bytes and in strings alike.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES, BETWEEN = re.compile(TERM.encode()), re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX_SCHEMA = "n_docs long, n_terms long, ids array<long>, lengths binary, terms array<int>, dfs array<int>, docs binary, counts binary"


def terms(text: Column) -> Column:
    """Distinct terms of a string."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in order, cut where no term is."""
    start = 0
    while start < len(text):
        found = BETWEEN.search(text, start + PIECE_BYTES)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


class ShardBuilder:
    """Gathers documents until a shard is full; `row` gives what is stored of it."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.bytes, self.n_docs, self.n_terms = 0, 0, 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.found: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: bytes) -> None:
        known, length = [], 0
        for piece in pieces(text):
            words = TERM_BYTES.findall(piece.lower())  # of bytes, only A-Z are lower-cased
            length += len(words)
            known.append(np.fromiter(filter(None, map(self.vocabulary.get, words)), dtype=np.int64))
        self.bytes += len(text)
        if length:
            self.n_docs += 1
            self.n_terms += length
        if any(map(len, known)):
            self.ids.append(doc_id)
            self.lengths.append(length)
            self.found.append(np.concatenate(known))

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def row(self) -> pa.RecordBatch:
        n = len(self.ids)
        order = np.argsort(np.array(self.lengths, dtype=np.int64), kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        keys = np.concatenate([f * SHARD_DOCS + place[k] for k, f in enumerate(self.found)]) if n else np.zeros(0, dtype=np.int64)
        keys, counts = np.unique(keys, return_counts=True)
        held, dfs = np.unique(keys // SHARD_DOCS, return_counts=True)
        values = [
            pa.array([self.n_docs], pa.int64()),
            pa.array([self.n_terms], pa.int64()),
            pa.array([[self.ids[k] for k in order]], pa.list_(pa.int64())),
            pa.array([np.array(self.lengths, dtype=np.int64)[order].tobytes()], pa.binary()),
            pa.array([held.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([dfs.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([(keys % SHARD_DOCS).astype(np.uint16).tobytes()], pa.binary()),
            pa.array([counts.astype(np.uint32).tobytes()], pa.binary()),
        ]
        self.clear()
        return pa.RecordBatch.from_arrays(values, ["n_docs", "n_terms", "ids", "lengths", "terms", "dfs", "docs", "counts"])


def index_shards(docs: DataFrame, vocabulary: Callable[[], dict[bytes, int]]) -> DataFrame:
    """A row a shard: its documents and the postings of the vocabulary's terms, whose numbers start at 1."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = ShardBuilder(vocabulary())
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                shard.add(one.column(0)[0].as_py(), rows_of(one.column(1))[0])
                if shard.full():
                    yield shard.row()
        if shard.bytes:
            yield shard.row()

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), payload().alias("text")), build, INDEX_SCHEMA)


class MaxTree:
    """A shard's postings, sorted by term and document, and the greatest impact of every term in every range of documents."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, vocabulary: int) -> None:
        self.ids = row["ids"]
        lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        self.docs = np.frombuffer(row["docs"], dtype=np.uint16).astype(np.int64)
        counts = np.frombuffer(row["counts"], dtype=np.uint32).astype(np.int64)
        held, dfs = np.array(row["terms"], dtype=np.int64), np.array(row["dfs"], dtype=np.int64)
        self.slot = np.full(vocabulary + 1, -1, dtype=np.int64)
        self.slot[held] = np.arange(len(held))
        m = 10 + (90 * lengths * n_docs) // n_terms
        self.impact = (1_000_000_000 * counts) // (1000 * counts + 8 * m[self.docs])
        self.ranges = max(1, -(-len(lengths) // LEAF))
        self.keys = np.repeat(np.arange(len(held)), dfs) * self.ranges + self.docs // LEAF  # ascending
        starts = np.flatnonzero(np.diff(self.keys, prepend=-1))
        lowest = np.zeros(len(held) * self.ranges, dtype=np.int32)
        if len(starts):
            lowest[self.keys[starts]] = np.maximum.reduceat(self.impact, starts)
        self.levels = [lowest.reshape(len(held), self.ranges)]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FANOUT), axis=1))

    def scores(self, slots: np.ndarray, weights: np.ndarray, node: int) -> np.ndarray:
        """Exact scores of the documents of a lowest range."""
        a, b = np.searchsorted(self.keys, slots * self.ranges + node, "left"), np.searchsorted(self.keys, slots * self.ranges + node, "right")
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = np.zeros(LEAF, dtype=np.int64)
        np.add.at(out, self.docs[at] - node * LEAF, self.impact[at] * np.repeat(weights, n))
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int, int]], k: int) -> int:
        """Puts documents into best, a heap of k (score, has an id, -id), lowest first; returns how many lowest ranges it opened."""
        slots = self.slot[terms]
        weights, slots = weights[slots >= 0], slots[slots >= 0]
        if not len(slots):
            return 0
        top = len(self.levels) - 1
        open_nodes = [(-int(weights @ self.levels[top][slots, 0].astype(np.int64)), top, 0)]
        opened = 0
        while open_nodes:
            bound, level, node = heapq.heappop(open_nodes)
            if not bound or len(best) == k and -bound < best[0][0]:
                break
            if level:
                start = node * FANOUT
                bounds = weights @ self.levels[level - 1][slots, start : start + FANOUT].astype(np.int64)
                for child, b in enumerate(bounds.tolist()):
                    if b and (len(best) < k or b >= best[0][0]):
                        heapq.heappush(open_nodes, (-b, level - 1, start + child))
                continue
            opened += 1
            scores = self.scores(slots, weights, node)
            for at in np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1)).tolist():
                doc_id = self.ids[node * LEAF + at]
                entry = (int(scores[at]), int(doc_id is not None), -(doc_id or 0))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return opened


def search_shards(index: DataFrame, given: Callable[[], tuple], kind: str, k: int) -> DataFrame:
    """(item_id, doc_id, score): of each item the k best documents of a task's shards. given: items' ids, their terms, weights, documents, terms of all."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, weights, n_docs, n_terms = given()
        best: list[list[tuple[int, int, int]]] = [[] for _ in asked]
        for batch in batches:
            for at in range(len(batch)):
                tree = MaxTree(batch.slice(at, 1).to_pylist()[0], n_docs, n_terms, len(weights) - 1)
                for own, held in zip(asked, best, strict=True):
                    tree.search(own, weights[own], held, k)
        rows = [(item, -neg if known else None, score) for item, held in enumerate(best) for score, known, neg in held]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["item_id", "doc_id", "score"])

    return arrow_map(index, search, f"item_id {kind}, doc_id long, score long")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search_block(docs: DataFrame, items: pa.Table, kind: str, k: int) -> DataFrame:
    """(item_id, doc_id, score) of one block of items (item_id, terms), k a task at most."""
    spark = docs.sparkSession
    listed = items.column("terms").combine_chunks()
    coded = listed.flatten().dictionary_encode()
    numbers, ends = coded.indices.to_numpy() + 1, listed.offsets.to_numpy()
    words = coded.dictionary.to_pylist()
    index = cut(index_shards(docs, share(spark, {w.encode(): n for n, w in enumerate(words, 1)})))
    totals = index.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    if not totals["n_terms"]:
        return spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df")).toArrow()  # a row a term of the block
    weights = np.zeros(len(words) + 1, dtype=np.int64)
    for term, df in zip(held.column(0).to_pylist(), held.column(1).to_pylist(), strict=True):
        weights[term] = weight(totals["n_docs"], df)
    asked = [numbers[a:b].astype(np.int64) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    given = share(spark, (items.column("item_id").combine_chunks(), asked, weights, totals["n_docs"], totals["n_terms"]))
    return search_shards(index, given, kind, k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item by score, equal ones by ascending doc_id; only scores above 0."""
    kind = items.schema["item_id"].dataType.simpleString()
    with passing_tables() as keep:
        words = items.select("item_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
        asked = cut(words.withColumn("size", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 8)))
        total = asked.agg(F.sum("size")).first()[0] or 0
        n_blocks = max(1, -(-total // block_bytes))
        found = None
        for block in range(n_blocks if total else 0):
            own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).select("item_id", "terms").toArrow()  # about block_bytes of terms
            if len(own):
                part = cut(search_block(docs, own, kind, k))
                found = part if found is None else found.unionByName(part)
        if found is None:
            return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return keep(cut(ranked.select("item_id", "rank", "doc_id", "score")))
