"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.text import arrow_map, cut, discard, mix, payload, share, text_parts

#: N-grams hash to so many buckets; the model keeps the most telling of them, 2**15 at most.
BUCKET_BITS, ORDERS, FEATURES = 20, (5, 6), 8192
#: The classifier is fitted on a bounded sample of the labelled rows. The driver holds their features by two bytes each (328 MB if every
#: row had all FEATURES) and computes with some FIT_FEATURES of them at once.
SAMPLE_ROWS, FIT_FEATURES = 20_000, 1 << 20
SMOOTH, RIDGE, STEPS, RATE, KEEP = 1.0, 1e-3, 250, 0.3, 0.9

_FOLD = np.full(128, 0x20, dtype=np.uint64)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: bytes) -> np.ndarray:
    """The text's characters, A-Z lower-cased and ASCII other than letters and digits as blanks."""
    if text.isascii():
        return _FOLD[np.frombuffer(text, dtype=np.uint8)]
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return np.where(points < 128, _FOLD[np.minimum(points, 127)], points.astype(np.uint64))


def bucket_ids(text: bytes) -> list[np.ndarray]:
    """Bucket of each character n-gram, runs of blanks as one and a blank at both ends, for every order. A character is a code point, of whatever script."""
    folded = code_points(text)
    blank = folded == 0x20
    folded = np.concatenate([[np.uint64(0x20)], folded[~(blank & np.concatenate([[True], blank[:-1]]))], [np.uint64(0x20)]])
    out = []
    for n in ORDERS:
        m = max(0, len(folded) - n + 1)
        key = np.full(m, np.uint64(n))
        for k in range(n):
            key = key * _FACTOR + folded[k : k + m]
        out.append((mix(key) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return out


@dataclass
class ToxicModel:
    """slot: feature of each bucket or -1; ratio: log-count ratio of each feature; weight: of the scaled features."""

    slot: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def present(self, text: bytes) -> np.ndarray:
        found = np.concatenate([self.slot[ids] for ids in bucket_ids(text)])
        return np.unique(found[found >= 0])

    def score(self, text: bytes) -> float:
        z = self.bias + float((self.weight * self.ratio)[self.present(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def choose_features(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, n: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that tell most, and their ratios, from the numbers of toxic and of clean documents that hold each."""
    ratio = np.log((SMOOTH + toxic) / (SMOOTH * 2 + n_toxic)) - np.log((SMOOTH + clean) / (SMOOTH * 2 + n_clean))
    worth = np.abs(ratio) * np.sqrt(np.minimum(toxic + clean, n_toxic))
    worth[toxic + clean < 3] = 0
    chosen = np.sort(np.argsort(-worth, kind="stable")[:n])
    chosen = chosen[worth[chosen] > 0]
    return chosen, ratio[chosen]


def row_blocks(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(first row, last row + 1) of consecutive rows of about `size` features together, one row at least."""
    out, start = [], 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        out.append((start, end))
        start = end
    return out


def fit_linear(features: np.ndarray, offsets: np.ndarray, labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on present features scaled by their ratios, by Adam on the whole sample; pulled to naive Bayes by 1 - KEEP.

    Row i has features[offsets[i] : offsets[i + 1]]. Each step adds up the gradients of blocks of FIT_FEATURES, which are all that is unfolded at once.
    """
    n, blocks = len(labels), row_blocks(offsets, FIT_FEATURES)
    weight, bias = np.zeros(len(ratio)), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for step in range(1, STEPS + 1):
        effect, slope, total = weight * ratio, np.zeros(len(ratio)), 0.0
        for a, z in blocks:
            col, row = features[offsets[a] : offsets[z]].astype(np.int64), np.repeat(np.arange(z - a), np.diff(offsets[a : z + 1]))
            logit = bias + np.bincount(row, weights=effect[col], minlength=z - a)
            error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels[a:z]) / n
            slope += np.bincount(col, weights=error[row], minlength=len(ratio))
            total += error.sum()
        grad = np.append(slope * ratio + RIDGE * weight, total)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
    return KEEP * weight + (1 - KEEP) * (np.abs(weight).mean() if len(weight) else 0.0) * (ratio != 0), bias


def feature_values(rows: pa.BinaryArray) -> np.ndarray:
    """The numbers of two bytes of all rows, one after the other, without a copy. There are no nulls."""
    _, offsets, data = rows.buffers()
    ends = np.frombuffer(offsets, np.int32)[rows.offset : rows.offset + len(rows) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int16) if data else np.zeros(0, np.int16)


def sample_labels(labels: DataFrame, usable: Column, bound: int = SAMPLE_ROWS) -> DataFrame:
    """At most `bound` usable labelled documents (doc_id, toxic), by the least hash of the id; a document of several labels counts as toxic if one says so."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def bucket_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Toxic and clean documents that have each bucket, and how many there are. texts: toxic, text. Tasks send what they have counted, at most a row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((2, 1 << BUCKET_BITS), dtype=np.uint32), [0, 0]
        for part, rows in (x for batch in batches for x in text_parts(batch, 1)):
            for toxic, text in zip(part.column(0).to_pylist(), rows, strict=True):
                n[toxic] += 1
                held[toxic, np.unique(np.concatenate(bucket_ids(text)))] += 1
        at = np.flatnonzero(held.any(axis=0))
        buckets = np.append(at, -1)  # -1: the documents themselves
        yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), *(pa.array(np.append(held[k, at].astype(np.int64), n[k])) for k in (1, 0))], ["bucket", "toxic", "clean"])

    sums = arrow_map(texts, count, "bucket int, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = sums.toArrow()  # 2**BUCKET_BITS rows at most
    bucket, toxic, clean = (found.column(k).to_numpy() for k in range(3))
    totals = [np.zeros(1 << BUCKET_BITS, dtype=np.int64) for _ in range(2)]
    real = bucket >= 0
    totals[0][bucket[real]], totals[1][bucket[real]] = toxic[real], clean[real]
    return totals[0], totals[1], int(toxic[~real].sum()), int(clean[~real].sum())


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> ToxicModel:
    """A model of the usable rows (a condition on doc_id) among the labels; without any, all scores are next to 0. Of repeated rows of an id, the least text counts."""
    spark = docs.sparkSession
    # The sample has SAMPLE_ROWS rows of two numbers at most: it is broadcast, so texts don't shuffle to find their labels.
    sample = sample_labels(labels, usable)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), payload().alias("text")).join(F.broadcast(sample), "doc_id")
    texts = cut(texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text"))  # only the sample's texts are moved
    n_toxic_in, n_clean_in, n_toxic, n_clean = bucket_counts(texts)
    chosen, ratio = choose_features(n_toxic_in, n_clean_in, n_toxic, n_clean)
    slot = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
    slot[chosen] = np.arange(len(chosen))
    model = ToxicModel(slot, ratio, np.zeros(len(ratio)), -60.0)
    shared = share(spark, model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for part, rows in (x for batch in batches for x in text_parts(batch, 1)):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.present(t).astype(np.int16).tobytes() for t in rows], pa.binary())], ["toxic", "features"])

    found = arrow_map(texts, features, "toxic int, features binary").orderBy("toxic", "features").toArrow()  # SAMPLE_ROWS rows of FEATURES numbers at most
    discard(texts)
    if found.num_rows:
        labels, held = found.column(0).to_numpy().astype(np.float64), found.column(1).cast(pa.binary()).combine_chunks()
        del found
        offsets = np.concatenate([[0], np.cumsum(pc.binary_length(held).to_numpy().astype(np.int64) // 2)])
        model.weight, model.bias = fit_linear(feature_values(held), offsets, labels, ratio)
    return model


def score_texts(docs: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row, the score being the probability of a toxic label.

    Null and empty texts have no features and get the score of the bias. Rows are scored alone: null ids and repeated rows
    need no care, an empty table gives none, other columns are not read. A very long text is scored by all of its n-grams; a score of just the
    threshold counts as toxic. There is no shuffle; the model has a fixed size.
    """
    shared = share(docs.sparkSession, model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        effect = (model.weight * model.ratio).astype(np.float64)
        for batch in batches:
            scores = []
            for _, texts in text_parts(batch, 1):
                for text in texts:
                    z = model.bias + float(effect[model.present(text)].sum())
                    scores.append(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))))
            found = np.array(scores, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), payload().alias("text")), judge, "doc_id long, score double, predicted int")
