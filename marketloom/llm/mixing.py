"""Mixing sources to target weights by iterative proportional fitting (raking).

1. Vectors. Every text is read once: its tokens are counted, in all and by their hashes.
2. Topics. All documents of each language are clustered by how the TF-IDF of their words differs from the language's mean; languages without
   a target are one. Document frequencies, means and each round's centroids are sums over all vectors, added up by tasks and then by cluster.
   A document's topic is the nearest centroid of its language, larger clusters having lower numbers.
3. Cells. Tokens are summed by (source, language, topic). Values without a target are pooled, so cells are no more than the combinations
   of targets; those that have tokens reach the driver.
4. Raking. Weights of cells are scaled to the source, language and topic targets in turn until all hold.
5. Sampling. The same raking with probabilities of 1 at most and a budget of tokens gives each document its probability; a
   hash of its id decides, so a repeated run keeps the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.text import NOT_ALNUM, arrow_map, cut, discard, fold_table, joined_values, parts_of, payload, share, small_batches, text_parts, word_hashes

#: Topics of a language at most, dimensions that its words hash to.
TOPICS, TOPIC_BITS = 8, 12
DIMS = 1 << TOPIC_BITS
#: Vectors are added up as whole numbers of this part of 1, so that no order of rows changes a sum; what is nearer to its language's mean than LEAST_NORM has no direction.
UNIT, LEAST_NORM = 1 << 24, 1e-3
#: Bytes of dimensions (two each) that a task unfolds at once when it adds vectors up: few enough for the processor's cache, more where there are many sums.
DIM_BYTES, MOST_DIM_BYTES = 1 << 17, 1 << 21
#: Rounds of clustering; without targets for topics, their shares are raised to this power, which lifts rare ones.
CLUSTER_ROUNDS, TEMPER = 12, 0.5
ROUNDS, TOLERANCE = 500, 1e-9
DIMENSIONS = ("source", "lang", "topic")


@dataclass
class Targets:
    """Shares of tokens by value, each dimension's adding up to anything above 0. Values that aren't named keep, together, their share of all tokens.

    Without targets for topics, each is wanted by its share of all tokens raised to TEMPER: topics are learnt, so their sizes aren't known before.
    """

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float] | None = None

    def __post_init__(self) -> None:
        for name in DIMENSIONS:
            if any(v < 0 for v in (getattr(self, name) or {}).values()):
                raise ValueError("targets are not negative")


def word_counts(rows: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of words of each text, and the dimensions that they hash to, in order, with their counts."""
    hashes, first, _, _ = word_hashes(rows, fold_table(NOT_ALNUM))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        counts = np.bincount((hashes[a:b] >> np.uint64(64 - TOPIC_BITS)).astype(np.int64), minlength=DIMS)
        dims = np.flatnonzero(counts)
        yield b - a, dims.astype(np.uint16), counts[dims].astype(np.uint32)


def document_key() -> Column:
    """What tells documents apart: the id, or the text's digest where that is null."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("md5:"), F.md5(payload())))


@dataclass
class Rows:
    """Rows of a batch that have words: their places in it, and of each the first entry, the number of entries and its group's number; of entries the dimension and the weight, each row having length 1."""

    at: np.ndarray
    first: np.ndarray
    size: np.ndarray
    group: np.ndarray
    dims: np.ndarray
    weight: np.ndarray

    def __post_init__(self) -> None:
        self.place = np.repeat(self.group * DIMS, self.size) + self.dims  # in the vectors of all groups

    def dot(self, vectors: np.ndarray) -> np.ndarray:
        """Each row by all of its group's vectors (vectors, groups, DIMS), summed up row by row, so that the order of rows can't decide."""
        out, held = np.empty((len(vectors), len(self.at))), np.empty(len(self.place))
        for k, vector in enumerate(vectors if len(self.at) else ()):
            vector.ravel().take(self.place, out=held, mode="clip")  # places are known to be inside: without a check it takes half the time
            np.multiply(held, self.weight, out=held)
            np.add.reduceat(held, self.first, out=out[k])
        return out

    def sums(self, slot: np.ndarray, factor: np.ndarray, slots: int) -> np.ndarray:
        """Sums of rows times their factors by slot, in UNIT."""
        entries = self.weight * np.repeat(factor, self.size)
        entries *= UNIT
        np.rint(entries, out=entries)
        return np.bincount(np.repeat(slot, self.size) * DIMS + self.dims, weights=entries, minlength=slots * DIMS).astype(np.int64).reshape(slots, DIMS)


@dataclass
class TopicModel:
    """idf of the dimensions, and by language its mean vector and unit centroids; languages without a target share those of ''."""

    idf: np.ndarray
    means: dict[str, np.ndarray]
    centroids: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        self.groups = list(self.means)
        most = max((len(c) for c in self.centroids.values()), default=0)
        self.mean = np.stack(list(self.means.values())) if self.groups else np.zeros((0, DIMS), np.float32)
        # Of every group all centroids, then the mean; a centroid that a group doesn't have is infinitely far.
        self.vectors = np.zeros((most + 1, len(self.groups), DIMS))
        self.offset = np.full((most, len(self.groups)), np.inf)
        self.square = (self.mean.astype(np.float64) ** 2).sum(axis=1)
        self.vectors[most] = self.mean
        for g, name in enumerate(self.groups):
            for k, centroid in enumerate(self.centroids.get(name, ())):
                self.vectors[k, g], self.offset[k, g] = centroid, np.dot(centroid.astype(np.float64), self.mean[g].astype(np.float64))

    def rows(self, batch: pa.RecordBatch) -> Rows:
        """The batch's vectors (group, dims, counts), but for those of groups that the model doesn't have."""
        number = {name: g for g, name in enumerate(self.groups)}
        group = np.array([number.get(x, -1) for x in batch.column("group").to_pylist()], dtype=np.int64)
        size = np.where(group >= 0, pc.binary_length(batch.column("dims")).to_numpy(zero_copy_only=False) // 2, 0).astype(np.int64)
        known = batch if (group >= 0).all() else batch.filter(pa.array(group >= 0))
        dims, counts = joined_values(known.column("dims"), np.uint16), joined_values(known.column("counts"), np.uint32)
        at = np.flatnonzero(size)
        size, dims = size[at], dims.astype(np.int64)
        first = np.cumsum(size) - size
        weight = np.sqrt(counts)
        weight *= self.idf.take(dims, mode="clip")
        if len(at):
            weight /= np.repeat(np.sqrt(np.add.reduceat(weight * weight, first)), size)
        return Rows(at, first, size, group[at], dims, weight)

    def topics(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row's residual, the first of equals; and 1 by the residual's length, 0 for those without a direction."""
        near = rows.dot(self.vectors)
        square = 1 - 2 * near[-1] + self.square[rows.group]
        inverse = np.where(square > LEAST_NORM**2, 1 / np.sqrt(np.maximum(square, LEAST_NORM**2)), 0.0)
        return (near[:-1] - self.offset[:, rows.group]).argmax(axis=0) if len(near) > 1 else np.zeros(len(rows.at), dtype=np.int64), inverse


def language_group(langs: dict[str, float]) -> Column:
    """'=' and the language where it has a target, else ''."""
    return F.coalesce(F.concat(F.lit("="), category("lang", langs)), F.lit(""))


def keyed(docs: DataFrame, langs: dict[str, float]) -> DataFrame:
    """(key, doc_id, source, lang, group, text) of every row."""
    given = docs.select(document_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), payload().alias("text"))
    return given.select("key", "doc_id", "source", "lang", language_group(langs).alias("group"), "text")


VECTOR_SCHEMA = "key string, doc_id long, source string, lang string, group string, n_tokens long, dims binary, counts binary"


def vectors(docs: DataFrame, langs: dict[str, float]) -> DataFrame:
    """A row for each document, with the counts of its words in place of its text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in text_parts(batch, 5):
                found = [(n, dims.tobytes(), counts.tobytes()) for n, dims, counts in word_counts(rows)]
                kinds = (pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:5], *(pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds))], [x.split()[0] for x in VECTOR_SCHEMA.split(", ")])

    return arrow_map(keyed(docs, langs), count, VECTOR_SCHEMA)


def document_frequencies(told: DataFrame) -> np.ndarray:
    """idf of every dimension, from all vectors."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(DIMS + 1, dtype=np.int64)  # the last one: vectors
        for batch in batches:
            for part in parts_of(batch, 0, MOST_DIM_BYTES):
                held[:DIMS] += np.bincount(joined_values(part.column(0), np.uint16), minlength=DIMS)
            held[DIMS] += len(batch)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["dim", "n"])

    held = np.zeros(DIMS + 1, dtype=np.int64)
    with small_batches(told.sparkSession):
        found = arrow_map(told.select("dims"), present, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # a row a dimension
    for row in found:
        held[row["dim"]] = row["n"]
    return np.log((1 + held[DIMS]) / (1 + held[:DIMS])) + 1


def start_vectors(told: DataFrame, topics: int) -> pa.RecordBatch:
    """(group, dims, counts) of the vectors that clusters begin at: of each of `topics` ranges of hashes in a group the least. Hashes take in the group, so that equal vectors of several groups are told apart."""
    hashed = told.select("group", F.xxhash64("group", "dims", "counts").alias("hash"), "dims", "counts")
    least = [r["hash"] for r in hashed.groupBy("group", F.pmod("hash", F.lit(topics)).alias("bucket")).agg(F.min("hash").alias("hash")).collect()]
    found = sorted(hashed.where(F.col("hash").isin(least)).dropDuplicates(["group", "hash"]).collect(), key=lambda r: (r["group"], r["hash"]))
    columns = [[r["group"] for r in found], *([bytes(r[c]) for r in found] for c in ("dims", "counts"))]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["group", "dims", "counts"])


def added_up(told: DataFrame, model: TopicModel, topics: int | None) -> dict[tuple[str, int], tuple[int, np.ndarray]]:
    """By group and topic: the number of vectors, and the sum of their residuals; without topics by group, and the sum of the vectors themselves.

    Tasks add up their own vectors; a row a task, group and topic is shuffled, a row a group and topic comes to the driver.
    """
    slots, shared = len(model.groups) * (topics or 1), share(told.sparkSession, model)
    limit = min(MOST_DIM_BYTES, max(DIM_BYTES, slots * DIMS // 2))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        n, inverse, sums = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros((slots, DIMS), np.int64)
        for rows in (model.rows(part) for batch in batches for part in parts_of(batch, 1, limit)):
            nearest, factor = model.topics(rows) if topics else (0, np.ones(len(rows.at)))
            slot = rows.group * (topics or 1) + nearest
            n += np.bincount(slot, minlength=slots)
            inverse += np.bincount(slot, weights=np.rint(factor * UNIT), minlength=slots).astype(np.int64)
            sums += rows.sums(slot, factor, slots)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(inverse[at]), pa.array([sums[k].tobytes() for k in at], pa.binary())], ["slot", "n", "inverse", "sums"])

    def whole(key: tuple[int], frame: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(DIMS, np.int64)
        for part in frame["sums"]:
            sums += np.frombuffer(part, np.int64)
        return pd.DataFrame({"slot": [key[0]], "n": [frame["n"].sum()], "inverse": [frame["inverse"].sum()], "sums": [sums.tobytes()]})

    schema, found = "slot long, n long, inverse long, sums binary", {}
    with small_batches(told.sparkSession):
        totals = arrow_map(told.select("group", "dims", "counts"), add, schema, frugal=limit < MOST_DIM_BYTES).groupBy("slot").applyInPandas(whole, schema).collect()
    for r in totals:
        g, k = divmod(r["slot"], topics or 1)
        sums = np.frombuffer(r["sums"], np.int64) / UNIT
        found[model.groups[g], k] = r["n"], sums - model.mean[g] * (r["inverse"] / UNIT) if topics else sums
    return found


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(1e-12, np.linalg.norm(x, axis=-1, keepdims=True))).astype(np.float32)


def clustered(told: DataFrame, idf: np.ndarray, means: dict[str, np.ndarray], starts: pa.RecordBatch, topics: int, rounds: int) -> tuple[TopicModel, dict[str, list[int]]]:
    """Spherical k-means of the residuals of (group, dims, counts) in each group of `means`, from these starts, and how many vectors each cluster had in the last round."""
    groups = sorted(means)
    rows = TopicModel(idf, {g: means[g] for g in groups}, {}).rows(starts)
    begun = rows.sums(rows.at, np.ones(len(rows.at)), len(starts))[rows.at] / UNIT
    model, sizes = TopicModel(idf, means, {name: unit(begun[rows.group == g] - means[name]) for g, name in enumerate(groups)}), {}
    for _ in range(rounds):
        found = added_up(told, model, topics)
        # Equal sizes go by the numbers of the round before.
        order = {g: sorted((k for name, k in found if name == g), key=lambda k: (-found[g, k][0], k)) for g in groups}  # noqa: B023
        before, model = model, TopicModel(idf, means, {g: np.stack([unit(found[g, k][1]) for k in order[g]]) for g in groups})
        sizes = {g: [found[g, k][0] for k in order[g]] for g in groups}
        if all(np.array_equal(before.centroids[g], model.centroids[g]) for g in groups):
            break
    return model, sizes


def fit_topics(table: DataFrame, topics: int = TOPICS) -> TopicModel:
    """Spherical k-means over all vectors with words, every language by itself; copies count as often as they are there. Clusters without vectors go, larger ones come first."""
    told = table.where("n_tokens > 0").select("group", "dims", "counts")
    idf, starts = document_frequencies(told), start_vectors(told, topics)
    groups = sorted(set(starts.column("group").to_pylist()))
    empty = TopicModel(idf, {g: np.zeros(DIMS, np.float32) for g in groups}, {})
    means = {g: (sums / n).astype(np.float32) for (g, _), (n, sums) in sorted(added_up(told, empty, None).items())}
    return clustered(told, idf, means, starts, topics, CLUSTER_ROUNDS)[0]


def learn_topics(docs: DataFrame, langs: dict[str, float], topics: int = TOPICS) -> TopicModel:
    """Topics of all documents with words. What the driver gathers is bounded by the targets."""
    table = cut(vectors(docs, langs))
    model = fit_topics(table, topics)
    discard(table)
    return model


PROFILE_SCHEMA = "key string, doc_id long, source string, lang string, topic string, n_tokens long"


def placed(table: DataFrame, model: TopicModel) -> DataFrame:
    """Profiles of vectors: key, id, source, lang, topic (null without words), tokens."""
    shared = share(table.sparkSession, model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            for part in parts_of(batch, 6, DIM_BYTES):
                rows, topics = model.rows(part), np.full(len(part), None, dtype=object)
                topics[rows.at] = [str(k) for k in model.topics(rows)[0]]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(topics, pa.string()), part.column("n_tokens")], [x.split()[0] for x in PROFILE_SCHEMA.split(", ")])

    return arrow_map(table, place, PROFILE_SCHEMA)


def profiles(docs: DataFrame, langs: dict[str, float], model: TopicModel) -> DataFrame:
    """A row for each document without its text: key, id, source, lang, topic (null without words), tokens."""
    return placed(vectors(docs, langs), model)


def category(name: str, named: dict[str, float]) -> Column:
    """The column's value if it has a target, else null (pooled)."""
    return F.when(F.col(name).isin(list(named)), F.col(name)) if named else F.lit(None).cast("string")


@dataclass
class Cells:
    """Tokens of the (source, lang, topic) cells that have some. at: a row a dimension, of each cell's value; the last value of each dimension is what is pooled."""

    values: list[list[str]]
    at: np.ndarray
    tokens: np.ndarray
    targets: list[np.ndarray]

    def margin(self, axis: int, factor: np.ndarray | float = 1.0) -> np.ndarray:
        return np.bincount(self.at[axis], weights=self.tokens * factor, minlength=len(self.targets[axis]) if self.targets else len(self.values[axis]) + 1)


def named_values(targets: Targets, name: str) -> dict[str, float]:
    """The values of a dimension that are not pooled, with their targets (0 where topics have none)."""
    return getattr(targets, name) if getattr(targets, name) is not None else {str(k): 0.0 for k in range(TOPICS)}


def gather_cells(profile: DataFrame, targets: Targets) -> Cells:
    values = [list(named_values(targets, name)) for name in DIMENSIONS]
    cells = profile.groupBy(*(category(name, named_values(targets, name)).alias(name) for name in DIMENSIONS)).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    place = [{x: k for k, x in enumerate(v)} | {None: len(v)} for v in values]
    rows = sorted((*(at[row[name]] for name, at in zip(DIMENSIONS, place, strict=True)), row["tokens"]) for row in cells.toLocalIterator())  # combinations of targets at most
    found = np.array(rows, dtype=np.int64).reshape(-1, 4)
    out = Cells(values, found[:, :3].T, found[:, 3].astype(float), [])
    total, shares = max(1.0, out.tokens.sum()), []
    for axis, name in enumerate(DIMENSIONS):
        margin = out.margin(axis)
        given, pooled = getattr(targets, name), margin[-1] / total
        wanted = np.array([*given.values(), 0.0]) if given is not None else np.append(margin[:-1] ** TEMPER, 0.0)
        wanted[margin == 0] = 0  # no documents to fill it with: the others share it
        if wanted.sum() > 0:
            wanted *= (1 - pooled) / wanted.sum()
            wanted[-1] = pooled
        else:
            wanted = margin / total
        shares.append(wanted)
    out.targets = shares
    return out


def rake(cells: Cells, budget: float, most: float = np.inf) -> np.ndarray:
    """A factor for each cell, `most` at most, so that tokens * factor have the target margins of `budget` tokens, as far as cells allow.

    Each step scales one dimension; what targets that no cells can meet leave over is seen in the margins that `achieved` gives.
    """
    total = cells.tokens.sum()
    factor = np.full(len(cells.tokens), min(most, budget / total if total else 0.0))
    for _ in range(ROUNDS):
        before = factor
        for axis, wanted in enumerate(cells.targets):
            margin = cells.margin(axis, factor)
            scale = np.where(margin > 0, wanted * budget / np.where(margin > 0, margin, 1.0), 0.0)
            factor = np.minimum(most, factor * scale[cells.at[axis]])
        if np.abs(factor - before).max(initial=0.0) <= TOLERANCE:
            break
    return factor


def achieved(cells: Cells, factor: np.ndarray) -> list[np.ndarray]:
    """Shares of tokens * factor by dimension."""
    return [cells.margin(axis, factor) / max(1e-12, (cells.tokens * factor).sum()) for axis in range(3)]


def lookup(cells: Cells, weight: np.ndarray, probability: np.ndarray, spark) -> DataFrame:
    """(source, lang, topic, weight, probability) of the cells; null is what is pooled."""
    names = [[*v, None] for v in cells.values]
    rows = [(*(names[axis][k] for axis, k in enumerate(at)), w, p) for at, w, p in zip(cells.at.T.tolist(), weight.tolist(), probability.tolist(), strict=True)]
    return spark.createDataFrame(rows, "c_source string, c_lang string, c_topic string, weight double, probability double")


def mix_documents(docs: DataFrame, targets: Targets, fraction: float = 0.5, seed: int = 17) -> DataFrame:
    """(key, doc_id, source, lang, topic, n_tokens, weight, probability, sampled) of every row.

    weight: target tokens of the document's cell by its tokens (1: as it is). probability: so that the expected sampled tokens are
    `fraction` of all and meet the targets as far as no document is taken twice. sampled: whether the document is drawn.
    Null sources and languages and those without a target are pooled and keep their share. A text without words (null, empty) has no tokens and no
    topic; its weight is 1, its probability `fraction`. A very long text is counted whole and drawn or not as one; of topics at equal cosines the lowest
    number counts, and draws at the probability itself are out. Rows with a null id draw by their text; repeated rows draw alike. An empty table gives none.
    Other columns are not read.
    """
    told = cut(vectors(docs, targets.lang))
    profile = cut(placed(told, fit_topics(told)))
    discard(told)
    cells = gather_cells(profile, targets)
    weight, probability = rake(cells, cells.tokens.sum()), rake(cells, fraction * cells.tokens.sum(), 1.0)
    table = lookup(cells, weight, probability, docs.sparkSession)
    match = [category(name, named_values(targets, name)).eqNullSafe(F.col(f"c_{name}")) for name in DIMENSIONS]
    joined = profile.join(table, match[0] & match[1] & match[2] & (F.col("n_tokens") > 0), "left")
    chance = F.coalesce("probability", F.lit(float(fraction)))
    draw = F.xxhash64("key", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return joined.select("key", "doc_id", "source", "lang", "topic", "n_tokens", F.coalesce("weight", F.lit(1.0)).alias("weight"), chance.alias("probability"), (draw < chance).alias("sampled"))
