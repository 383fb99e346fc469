"""Language identification: nearest of several centroids per language, by cosine of TF-IDF n-gram vectors, with rejection by distance.

1. Vectors. Every labelled text is read once and its trigrams are counted.
2. Centroids. All vectors of each language are clustered by k-means whose rounds are sums by tasks, and those of each half of its texts as well.
3. Bounds. Pieces of every labelled text are compared with the clusters of the half that it isn't in; least cosines are quantiles of their counts.

A language more is a group more and none is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.mixing import clustered, document_frequencies, start_vectors
from marketloom.llm.text import arrow_map, cut, discard, free_names, in_sample, packed_rows, payload, quoted, sample_bounds, share, small_batches, text_parts, unpacked

DIMS = 4096
#: Languages that are fitted at once: a task holds 12 sums of 32 KB for each.
FIT_LANGS = 64
#: Languages that a task compares with at once; a model of more is broadcast in blocks, which are held one at a time.
BLOCK_LANGS = 256
CENTROIDS, ROUNDS = 4, 12
#: Clusters of a smaller share of their language's rows go.
LEAST_SHARE = 0.02
#: Lengths in trigrams for which the least cosine is measured on held-out pieces; it falls to 0 at half the first length.
LENGTHS = 16 << np.arange(9)
#: Cosines are counted in steps of 1 / BINS, the lower end being taken.
BINS = 1 << 12
#: A text is rejected below the cosine that all but REJECT_QUANTILE of the pieces of its length reach. A language with fewer than
#: LEAST_PIECES of them takes those of all languages.
REJECT_QUANTILE, LEAST_PIECES = 0.005, 200
UNKNOWN = "und"

_LETTER = np.full(256, 0x20, dtype=np.uint64)
_LETTER[128:] = np.arange(128, 256)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)


def has_letter(text: bytes, folded: np.ndarray) -> bool:
    if bool(((folded > 0x20) & (folded < 128)).any()):
        return True
    return bool((folded >= 128).any()) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def ngram_ids(text: bytes) -> np.ndarray | None:
    """Hashes of the text's byte trigrams in order, words being padded with a blank and all ASCII but letters being one; None without a letter."""
    folded = _LETTER[np.frombuffer(text, dtype=np.uint8)]
    if not has_letter(text, folded):
        return None
    blank = folded == 0x20
    folded = np.concatenate([[np.uint64(0x20)], folded[~(blank & np.concatenate([[True], blank[:-1]]))], [np.uint64(0x20)]])
    a, b, c = folded[:-2], folded[1:-1], folded[2:]
    key = (a << np.uint64(16) | b << np.uint64(8) | c) * np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(52)).astype(np.int64)


def counts_of(ids: np.ndarray) -> np.ndarray:
    return np.bincount(ids, minlength=DIMS).astype(np.float32)


def ngram_counts(text: bytes) -> np.ndarray | None:
    """Hashed counts of the text's byte trigrams; None without a letter."""
    ids = ngram_ids(text)
    return None if ids is None else counts_of(ids)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of square-root frequencies times idf."""
    x = np.sqrt(counts) * idf
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=-1, keepdims=True))


@dataclass
class CentroidModel:
    """Unit centroids (rows) with their languages and the least cosines to accept, a column for each of LENGTHS."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, for each row of counts."""
        if not self.langs:
            return [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), dtype=bool)
        near = weighted(counts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(near)), best], 0.0, 1.0).astype(np.float64)
        return [self.langs[i] for i in best], score, (score <= 0) | (score < self.bound(best, counts.sum(axis=1)))

    def bound(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The least cosine of these centroids for texts of n trigrams: between two lengths, by the logarithm; texts of few trigrams can't be judged."""
        at = np.clip(np.log2(np.maximum(1, n) / LENGTHS[0]) + 1, 0, len(LENGTHS))
        low = np.minimum(at.astype(np.int64), len(LENGTHS) - 1)
        least = np.concatenate([np.zeros((len(self.least), 1)), self.least], axis=1)
        return least[best, low] + (at - low) * (least[best, low + 1] - least[best, low])


def piece_places(size: int) -> list[tuple[int, int, int]]:
    """(place in LENGTHS, start, end) of the pieces of a text of so many trigrams: of each length the first and the last one of the whole text."""
    return [(i, a, a + n) for i, n in enumerate(LENGTHS.tolist()) if size >= n for a in sorted({0, (size // n - 1) * n})]


def cut_pieces(ids: np.ndarray) -> np.ndarray:
    """The trigrams of a text's pieces, one after the other."""
    return np.concatenate([ids[a:z] for _, a, z in piece_places(len(ids))] or [ids[:0]]).astype(np.uint16)


def pieces_of(size: int, held: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(place in LENGTHS, trigrams) of what cut_pieces made of a text of so many trigrams."""
    places = piece_places(size)
    return list(zip([i for i, _, _ in places], np.split(held, np.cumsum([z - a for _, a, z in places])[:-1]), strict=True)) if places else []


def piece_cosines(ids: np.ndarray, idf: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in LENGTHS and cosines to the nearest centroid, of the pieces of a text."""
    pieces = pieces_of(len(ids), cut_pieces(ids))
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0)
    counts = np.stack([counts_of(p) for _, p in pieces])
    return np.array([i for i, _ in pieces]), (weighted(counts, idf) @ centroids.T).max(axis=1)


def low_quantile(counts: np.ndarray) -> float:
    """The REJECT_QUANTILE of cosines, between ranks by proportion, from how many each of BINS has."""
    rank = REJECT_QUANTILE * (counts.sum() - 1)
    low, high = np.searchsorted(np.cumsum(counts), [np.floor(rank), np.ceil(rank)], side="right")
    return float(low + rank % 1 * (high - low)) / BINS


def least_cosines(own: dict[int, tuple[int, float]], every: np.ndarray) -> np.ndarray:
    """The bound for each of LENGTHS, from (pieces, quantile) of the language, or where it has too few from the counts of all; where these are too few, that of the length before."""
    least = np.zeros(len(LENGTHS))
    for i in range(len(LENGTHS)):
        n, bound = own.get(i, (0, 0.0))
        least[i] = bound if n >= LEAST_PIECES else low_quantile(every[i]) if every[i].sum() >= LEAST_PIECES else least[i - 1] if i else 0.0
    return least


def labelled_rows(docs: DataFrame, usable: Column, per_lang: int | None) -> DataFrame:
    """(lang, half, text) of the usable rows with a text and a lang; equal texts are in the same half."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), payload().alias("text"), F.col("doc_id").cast("long").alias("id"), F.coalesce(usable, F.lit(False)).alias("usable"))
    rows = rows.where(F.col("usable") & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    if per_lang is not None:
        rows = rows.where(in_sample("lang", F.xxhash64("id", "text", F.lit(9)), sample_bounds(rows, "lang", per_lang)))
    return rows.select("lang", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), "text")


def trigram_vectors(rows: DataFrame) -> DataFrame:
    """(lang, half, dims, counts) of each text with a letter: the dimensions that its trigrams hash to, in order (two bytes each), and their counts (four)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch, 2):
                at, dims, counts = [], [], []
                for k, ids in enumerate(map(ngram_ids, texts)):
                    if ids is not None:
                        held = np.bincount(ids, minlength=DIMS)
                        found = np.flatnonzero(held)
                        at.append(k)
                        dims.append(found.astype(np.uint16).tobytes())
                        counts.append(held[found].astype(np.uint32).tobytes())
                known = part.select(["lang", "half"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*known.columns, pa.array(dims, pa.binary()), pa.array(counts, pa.binary())], ["lang", "half", "dims", "counts"])

    return arrow_map(rows, count, "lang string, half int, dims binary, counts binary")


def fit_centroids(told: DataFrame, idf: np.ndarray) -> dict[str, np.ndarray]:
    """Unit centroids of all vectors of each language ('+' and its name) and of each half of them ('0', '1' and its name)."""
    grouped = told.select(F.explode(F.array(F.concat(F.lit("+"), "lang"), F.concat(F.col("half").cast("string"), F.col("lang")))).alias("group"), "dims", "counts")
    starts = start_vectors(grouped, CENTROIDS)
    model, sizes = clustered(grouped, idf, {g: np.zeros(DIMS, np.float32) for g in sorted(set(starts.column("group").to_pylist()))}, starts, CENTROIDS, ROUNDS)
    # Clusters of next to no rows are no part of a language.
    return {g: x[np.array(sizes[g]) >= LEAST_SHARE * sum(sizes[g])] for g, x in model.centroids.items()}


def piece_bounds(rows: DataFrame, langs: list[str], idf: np.ndarray, centroids: dict[str, np.ndarray]) -> tuple[list[dict[int, tuple[int, float]]], np.ndarray]:
    """For each language by place in LENGTHS the number of its pieces and the quantile of their cosines to clusters of the other half; and how many cosines all have, by place and bin.

    Tasks count cosines by bins; a row a language, length and bin is shuffled, 32 KB a length and a number a language and length come to the driver.
    """
    shared = share(rows.sparkSession, (langs, idf, centroids))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, idf, centroids = shared()
        number, size = {name: k for k, name in enumerate(langs)}, len(LENGTHS) * BINS
        held = np.zeros((len(langs) + 1) * size, np.int64)  # the last ones: of all languages
        for batch in batches:
            for part, texts in text_parts(batch, 2):
                for lang, half, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                    other, ids = centroids.get(f"{1 - half}{lang}"), ngram_ids(text)
                    if other is not None and ids is not None:
                        length, near = piece_cosines(ids, idf, other)
                        place = length * BINS + np.clip((near * BINS).astype(np.int64), 0, BINS - 1)
                        np.add.at(held, number[lang] * size + place, 1)
                        np.add.at(held, len(langs) * size + place, 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at // size), pa.array(at % size // BINS), pa.array(at % BINS), pa.array(held[at])], ["lang", "length", "bin", "n"])

    def bound(key: tuple[int, int], frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(BINS, np.int64)
        held[frame["bin"]] = frame["n"]
        return pd.DataFrame({"lang": [key[0]], "length": [key[1]], "n": [held.sum()], "least": [low_quantile(held)], "held": [held.tobytes() if key[0] == len(langs) else None]})

    own: list[dict[int, tuple[int, float]]] = [{} for _ in langs]
    every = np.zeros((len(LENGTHS), BINS), np.int64)
    counts = arrow_map(rows, count, "lang long, length long, bin long, n long").groupBy("lang", "length", "bin").agg(F.sum("n").alias("n"))
    with small_batches(rows.sparkSession):
        found = counts.groupBy("lang", "length").applyInPandas(bound, "lang long, length long, n long, least double, held binary").collect()
    for r in found:
        if r["held"] is None:
            own[r["lang"]][r["length"]] = r["n"], r["least"]
        else:
            every[r["length"]] = np.frombuffer(r["held"], np.int64)
    return own, every


def train(docs: DataFrame, usable: Column, per_lang: int | None = None) -> CentroidModel:
    """A model of all usable rows (a condition on doc_id) that have a text with a letter and a lang; repeated rows and equal texts count as often as they are there.

    Languages are fitted FIT_LANGS at a time. The driver holds sums of 12 clusters of 32 KB for each of these, then 64 KB a language.
    per_lang is for trials: about so many rows of a language, those with the least hashes of id and text.
    """
    rows = labelled_rows(docs, usable, per_lang)
    told = cut(trigram_vectors(rows))
    langs = sorted(r["lang"] for r in told.select("lang").distinct().collect())
    idf = document_frequencies(told).astype(np.float32)
    centroids, own, every = {}, [], np.zeros((len(LENGTHS), BINS), np.int64)
    for start in range(0, len(langs), FIT_LANGS):
        block = langs[start : start + FIT_LANGS]
        found = fit_centroids(told.where(F.col("lang").isin(block)), idf)
        centroids |= {name: found[f"+{name}"] for name in block}
        pieces, counts = piece_bounds(rows.where(F.col("lang").isin(block)), block, idf, {g: x for g, x in found.items() if g[0] != "+"})
        own, every = own + pieces, every + counts
    discard(told)
    return CentroidModel(
        idf,
        np.concatenate([centroids[name] for name in langs]) if langs else np.zeros((0, DIMS), np.float32),
        [name for name in langs for _ in centroids[name]],
        np.concatenate([np.tile(least_cosines(x, every), (len(centroids[name]), 1)) for name, x in zip(langs, own, strict=True)]) if langs else np.zeros((0, len(LENGTHS))),
    )


def blocks_of(model: CentroidModel, size: int = BLOCK_LANGS) -> list[CentroidModel]:
    """Models of `size` languages each, at least one."""
    langs = list(dict.fromkeys(model.langs))
    out = []
    for start in range(0, max(1, len(langs)), size):
        names = set(langs[start : start + size])
        rows = [i for i, name in enumerate(model.langs) if name in names]
        out.append(CentroidModel(model.idf, model.centroids[rows], [model.langs[i] for i in rows], model.least[rows]))
    return out


def judge_texts(texts: list[bytes], blocks: list[Callable[[], CentroidModel]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and whether it is rejected, of each text; of blocks that give equal cosines the first counts."""
    langs, scores, rejected = [UNKNOWN] * len(texts), np.full(len(texts), -1.0), np.ones(len(texts), dtype=bool)
    for block in blocks:
        model = block()
        for start in range(0, len(texts), 256):
            found = [(i, c) for i, c in ((i, ngram_counts(texts[i])) for i in range(start, min(start + 256, len(texts)))) if c is not None]
            if found:
                names, near, far = model.predict(np.stack([c for _, c in found]))
                for (i, _), name, cosine, no in zip(found, names, near.tolist(), far.tolist(), strict=True):
                    if cosine > scores[i]:
                        langs[i], scores[i], rejected[i] = name, cosine, no
    return langs, np.maximum(0.0, scores), rejected


def identify(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """The documents, all columns kept, with __lang_pred, __score (cosine) and __rejected (as free_names has them, where such columns are there).

    Null texts and texts without a letter get 'und', score 0 and are rejected, as are texts too far from every centroid. Rows
    are judged alone: null ids and repeated rows need no care, an empty table stays empty. A text of any length is one vector of DIMS
    counts; of centroids at equal cosines the first by language and cluster wins. There is no shuffle; the model has
    CENTROIDS vectors of DIMS numbers a language and is broadcast in blocks of BLOCK_LANGS languages.
    """
    shared = [share(docs.sparkSession, x) for x in blocks_of(model)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(shared) == 1:
            only = shared[0]()
            blocks: list[Callable[[], CentroidModel]] = [lambda: only]
        else:
            blocks = shared
        for batch in batches:
            for part, texts in text_parts(batch, 0):
                langs, scores, rejected = judge_texts(texts, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected), part.column(0), part.column(1)], schema.names)

    row, field = packed_rows(docs)
    schema = T.StructType().add("__lang_pred", "string").add("__score", "double").add("__rejected", "boolean").add("__text", "binary").add(field)
    out = arrow_map(docs.select(quoted("text").cast("binary").alias("__t"), row), judge, schema)
    found = ["__lang_pred", "__score", "__rejected"]
    return unpacked(out, docs.columns, *(F.col(c).alias(name) for c, name in zip(found, free_names(docs, *found), strict=True)))


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
