"""Jaccard join of word n-gram sets by signature trees.

1. Sets. Documents of equal sets (by 128-bit digests of all shingles) are one node, numbered by one of its rows. Shingles are ordered by their
   64-bit hashes, which stand for them: two that collide change a count by one.
2. Prefixes. Two sets of n and m shingles that are similar enough share L(least of both) of the first n - ceil(threshold * n) + L(n) of the one
   and m - ceil(threshold * m) + L(m) of the other. Sets with too few shingles that are in another prefix too have no partner and are done.
3. Keys. Of what is left all shingles are counted and ordered again, rare ones first. Similar sets share one of their first
   n - ceil(threshold * n) + 1 in this order; those that two sets have are keys. Sets without keys are done.
4. First groups. Sets meet at their first FIRST_KEYS keys. A group's sets are leaves of a tree whose nodes have the
   OR of their token bitmaps and the range of their sizes. A traversal of the tree with itself prunes node pairs by their
   greatest possible overlap, skips those that are linked already, and compares what is left exactly.
5. The rest. Where sets of different components share a key, they are joined by trees as
   well: sets of small components by cluster or key, sets that share one with a large component with all of that, in blocks.
   So every pair that may be linked is linked already or compared, and no task has more than two blocks.

Counts of groups are written before rows are joined to them, so that Spark can split these joins for a shingle, key or component of very many sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.bloom import may_be_in
from marketloom.llm.components import components
from marketloom.llm.text import SPACE, U64, arrow_map, cut, fold_table, mix, passing_tables, payload, short_hash, text_parts, windows_of, word_hashes

SHINGLE, PERCENT = 5, 80
#: Shared shingles at which a set meets others first; sets of a tree; sets of a large component.
FIRST_KEYS, CHUNK_NODES, LARGE_NODES = 2, 2000, 500
#: Shingles in a tree, all sets together.
CHUNK_TOKENS = 4_000_000
LEAF, FANOUT = 32, 8


def shingle_sets(rows: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; fewer words than `width` are one shingle, none are an empty set."""
    hashes, first, _, _ = word_hashes(rows, fold_table(SPACE))
    windows = windows_of(hashes, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        else:
            out.append(np.array([short_hash(hashes[a:b])] if b > a else [], dtype=np.uint64))
    return out


def set_digest(tokens: np.ndarray) -> bytes:
    """A set's 128-bit name; of no use for an empty set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def more_shared(n: int) -> int:
    """L(n): shingles that similar sets share in their longer prefixes."""
    return max(1, n // 10)


def prefixes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(row, doc_id, n, digest, prefix): number, size and name of every set, and once a task and set its longer prefix."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part, rows in text_parts(batch, 1):
                sizes, names, held = [], [], []
                for doc_id, tokens in zip(part.column(0).to_pylist(), shingle_sets(rows, width), strict=True):
                    n, name = len(tokens), set_digest(tokens)
                    sizes.append(n)
                    names.append(name)
                    if doc_id is None or name in seen or not n:
                        held.append(None)
                    else:
                        held.append(tokens[: prefix_length(n, percent) + more_shared(n) - 1].view(np.int64))
                        seen.add(name)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(held, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "prefix"])

    made = arrow_map(texts.select("doc_id", "text"), make, "doc_id long, n long, digest binary, prefix array<long>")
    return cut(made.withColumn("row", F.monotonically_increasing_id()))


def short_name() -> Column:
    """56 bits of a set's digest."""
    return F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")


def survivors(sets: DataFrame, percent: int) -> DataFrame:
    """(name) of sets that may have a partner: enough shingles of their prefixes are in another prefix too.

    Sets whose short names collide count as one that is no larger than the least of them, and so survive rather than not.
    """
    rows = sets.where("prefix is not null").select(short_name().alias("name"), "n", "prefix")
    tokens = rows.select("name", F.explode("prefix").alias("token"))
    shared = cut(tokens.groupBy("token").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low <> high").select("token"))
    held = tokens.join(shared, "token").groupBy("name").agg(F.count_distinct("token").alias("n_shared"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 10))
    return held.join(rows.groupBy("name").agg(F.min("n").alias("n")), "name").where(F.col("n_shared") >= least).select("name")


class SignatureTree:
    """Sets in leaves of LEAF, ordered by size; every node has the OR of bitmaps, the range of sizes and the most tokens that share bits."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.bitmap = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for i, tokens in enumerate(sets):
            place = (mix(tokens) & U64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(self.bitmap[i], place >> 6, U64(1) << (place & 63).astype(np.uint64))
        slack = self.size - np.bitwise_count(self.bitmap).sum(axis=1).astype(np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = [(self.bitmap, self.size, self.size, slack)]
        width = LEAF
        while len(self.levels[-1][1]) > 1 or len(self.levels) == 1:
            bitmap, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), width)
            self.levels.append((np.bitwise_or.reduceat(bitmap, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))
            width = FANOUT

    def children(self, level: int, node: int) -> range:
        width = LEAF if level == 1 else FANOUT
        return range(node * width, min((node + 1) * width, len(self.levels[level - 1][1])))


def possible(a: tuple, i: range, b: tuple, j: range, percent: int) -> np.ndarray:
    """Which pairs of nodes i of a and j of b may hold a link: by their sizes, and by the greatest overlap that their bitmaps allow."""
    i, j = slice(i.start, i.stop), slice(j.start, j.stop)
    shared = np.bitwise_count(a[0][i][:, None, :] & b[0][j][None, :, :]).sum(axis=2).astype(np.int64)
    low, other_low = a[1][i][:, None], b[1][j][None, :]
    high, other_high = a[2][i][:, None], b[2][j][None, :]
    overlap = np.minimum(np.minimum(shared + a[3][i][:, None], shared + b[3][j][None, :]), np.minimum(high, other_high))
    return (100 * high >= percent * other_low) & (100 * other_high >= percent * low) & ((100 + percent) * overlap >= percent * (low + other_low))


class Links:
    """Union of linked sets: the parent of each, itself for a root."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def join_tree(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None, known: list | None = None) -> list[int]:
    """The root of each set when all links among them are followed; if `left` marks some, only links of these count. Sets of equal `known` are linked already."""
    n = len(sets)
    order = sorted(range(n), key=lambda i: (len(sets[i]), sets[i][:1].tolist()))
    sets = [sets[i] for i in order]
    marked = None if left is None else left[order]
    links, met = Links(n), {}
    for i, original in enumerate(order):
        if known and known[original] is not None:
            links.parent[i] = met.setdefault(known[original], i)
    most = max((len(s) for s in sets), default=1)
    tree = SignatureTree(sets, min(1 << 14, max(256, 1 << (2 * most - 1).bit_length())))
    wanted = [marked]
    if marked is not None:
        for level in range(1, len(tree.levels)):
            wanted.append(np.array([wanted[-1][list(tree.children(level, k))].any() for k in range(len(tree.levels[level][1]))]))
    whole = [np.zeros(len(x[1]), dtype=bool) for x in tree.levels]
    whole[0][:] = True

    def first(level: int, node: int) -> int:
        return node * LEAF * FANOUT ** (level - 1) if level else node

    def one(level: int, node: int) -> bool:
        """Whether all sets below a node are linked already; that stays so."""
        if not whole[level][node]:
            below = tree.children(level, node)
            if all(whole[level - 1][k] for k in below) or (level > 1 and all([one(level - 1, k) for k in below])):
                whole[level][node] = len({links.find(first(level - 1, k)) for k in below}) == 1
        return bool(whole[level][node])

    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, p, q = stack.pop()
        if one(level, p) and one(level, q) and links.find(first(level, p)) == links.find(first(level, q)):
            continue
        i, j = tree.children(level, p), tree.children(level, q)
        may = possible(tree.levels[level - 1], i, tree.levels[level - 1], j, percent)
        if marked is not None:
            w = wanted[level - 1]
            may &= w[i.start : i.stop, None] | w[None, j.start : j.stop]
        found = [(i.start + a, j.start + b) for a, b in np.argwhere(may).tolist() if p != q or a <= b]
        if level > 1:  # a node with itself comes first, so that later pairs are linked already
            stack += [(level - 1, a, b) for a, b in sorted(found, key=lambda x: x[0] == x[1])]
            continue
        for a, b in found:
            if a != b:
                x, y = links.find(a), links.find(b)
                if x != y and linked(sets[a], sets[b], percent):
                    links.parent[max(x, y)] = min(x, y)
    root = [0] * n
    for at, original in enumerate(order):
        root[original] = order[links.find(at)]
    return root


def join_groups(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the links inside each group. sets: key, part (a group each), node, component (null: none yet), left (null: all), tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            rows = list({(x[2], x[4]): x for x in held}.values())
            asked = {x[2] for x in rows if x[4]}
            rows = [x for x in rows if x[4] or x[2] not in asked]  # a query set is there once
            left = None if rows[0][4] is None else np.array([x[4] for x in rows], dtype=bool)
            root = join_tree([x[5] for x in rows], percent, left, [x[3] for x in rows])
            links = [(x[2], rows[r][2]) for x, r in zip(rows, root, strict=True) if x[2] != rows[r][2]]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["node", "root"])

        for batch in batches:
            ends = batch.column(5).offsets.to_numpy()
            values = batch.column(5).values.to_numpy().view(np.uint64)
            tokens = [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            for row in zip(*(c.to_pylist() for c in batch.columns[:5]), tokens, strict=True):
                if held and row[:2] != held[0][:2]:
                    yield emit()
                    held.clear()
                held.append(row)
        if held:
            yield emit()

    dealt = sets.select("key", "part", "node", "component", "left", "tokens").repartition("key", "part").sortWithinPartitions("key", "part")
    return arrow_map(dealt, run, "node long, root long")


def kept_sets(texts: DataFrame, left: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of the survivors (node, digest, doc_id), each from that document; repeated rows of a doc_id give a row each.

    A Bloom filter of the survivors' ids keeps most other texts from being shuffled to the join.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in text_parts(batch, 2):
                named = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(rows, width), strict=True)
                out = [(node, tokens.view(np.int64)) for node, digest, tokens in named if set_digest(tokens) == digest]
                if out:  # else another row of the doc_id
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["node", "tokens"])

    joined = texts.where(may_be_in("doc_id", left)).join(left, "doc_id")
    return cut(arrow_map(joined.select("node", "digest", "text"), make, "node long, tokens array<long>"))


def keys_of(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, keys) of sets that may have a partner; n: its size; keys: the shingles among the first of the set, rare ones first, that another set has too."""
    rows = sets.select("node", F.explode("tokens").alias("token"))
    times = cut(rows.groupBy("token").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token", "times"))
    # Places in the order: the number of sets, then the hash; two shingles at one place only make a group larger.
    place = F.shiftleft(F.least("times", F.lit(65535)).cast("long"), 47).bitwiseOR(F.shiftrightunsigned("token", 17))
    own = F.array_sort(F.collect_set(F.struct(place.alias("place"), "token")))  # a set's own shingles only, once each
    held = rows.join(times, "token").groupBy("node").agg(own["place"].alias("held"))
    sizes = sets.select("node", F.size("tokens").alias("n")).distinct()
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("held"))  # shingles of one set only come before
    return cut(held.join(sizes, "node").where(first > 0).select("node", "n", F.slice("held", F.lit(1), first.cast("int")).alias("keys")))


def chunks() -> Column:
    """Parts for the sets of a group, by their number and by their shingles; a single set is a part at most."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_NODES), F.least(F.ceil(F.sum("n") / CHUNK_TOKENS), F.count(F.lit(1))))


def grouped(rows: DataFrame, sets: DataFrame, component: str = "null") -> DataFrame:
    """Sets by groups of rows (key, part, node)."""
    return rows.join(sets, "node").select("key", "part", "node", F.expr(f"cast({component} as long)").alias("component"), F.lit(None).cast("boolean").alias("left"), "tokens")


def first_links(sets: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """Links among sets that meet at one of their first keys; a group beyond CHUNK_NODES is dealt to parts, other keys deal otherwise."""
    rows = keys.select("node", "n", F.explode(F.slice("keys", 1, FIRST_KEYS)).alias("key"))
    parts = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), chunks().alias("parts")).where("size > 1"))
    dealt = rows.join(parts, "key").select("key", F.pmod(F.xxhash64("node", "key"), "parts").alias("part"), "node")
    return join_groups(grouped(dealt, sets), percent)


def label(keys: DataFrame, links: DataFrame) -> DataFrame:
    """(node, n, component, size) of every set with keys as linked so far; size: sets of its component."""
    found = components(links.select(F.col("root").alias("src"), F.col("node").alias("dst")))
    placed = cut(keys.select("node", "n").join(found, "node", "left").select("node", "n", F.coalesce("root", "node").alias("component")))
    return cut(placed.join(cut(placed.groupBy("component").agg(F.count(F.lit(1)).alias("size"))), "component"))


def last_links(sets: DataFrame, keys: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links among sets of different components that share a key."""
    rows = keys.select("node", F.explode("keys").alias("key")).join(labels, "node")
    mixed = cut(rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key"))
    open_rows = cut(rows.join(mixed, "key"))
    # What shares keys directly or by others is a cluster; as one group, each of its sets moves once.
    small = open_rows.where(F.col("size") <= LARGE_NODES)
    star = small.join(cut(small.groupBy("key").agg(F.min("node").alias("least"))), "key").select(F.col("least").alias("src"), F.col("node").alias("dst")).distinct()
    clusters = components(star).withColumnRenamed("root", "cluster")
    clusters = cut(clusters.join(labels.select("node", "n"), "node"))
    clusters = clusters.select("node", "cluster").join(cut(clusters.groupBy("cluster").agg(chunks().alias("cluster_parts"))), "cluster")
    placed = cut(small.join(clusters, "node"))
    whole = placed.where("cluster_parts = 1").select(F.col("cluster").alias("key"), "node", "component", F.lit(-1).cast("long").alias("part")).distinct()
    # Clusters of several parts: a group for each key; keys with the same sets are one group, as a passage has many.
    rest = placed.where("cluster_parts > 1")
    groups = rest.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("name"), F.min("component").alias("low"), F.max("component").alias("high"), chunks().alias("blocks"))
    groups = cut(groups.where("low <> high").groupBy("members", "name", "blocks").agg(F.min("key").alias("key")))
    dealt = rest.join(groups, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    # Each two blocks of a group meet in a part.
    dealt = dealt.select("key", "node", "component", F.col("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "node", "component", (F.least("block", "other") * 1_000_000 + F.greatest("block", "other")).alias("part")).unionByName(whole)
    among_small = join_groups(grouped(dealt, sets, "component"), percent)

    # A set that shares a key with a larger component asks all of that. Sets of large components ask those that are larger still.
    large = open_rows.where(F.col("size") > LARGE_NODES).select("key", F.col("component").alias("target"), F.col("size").alias("target_size")).distinct()
    asks = cut(open_rows.join(large, "key").where(F.struct("size", "component") < F.struct("target_size", "target")).select("node", "n", "target").distinct())
    asked_sets = labels.join(cut(asks.select("target").distinct()), F.col("component") == F.col("target"))
    counts = asks.groupBy("target").agg(chunks().alias("asking")).join(asked_sets.groupBy("target").agg(chunks().alias("asked")), "target")
    counts = cut(counts)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = asks.join(counts, "target").select(F.col("target").alias("key"), "node", F.pmod(F.xxhash64("node"), "asking").alias("a"), each("asked").alias("b"), F.lit(True).alias("left"))
    asked = asked_sets.join(counts, "target").select(F.col("target").alias("key"), "node", F.pmod(F.xxhash64("node"), "asked").alias("b"), each("asking").alias("a"), F.lit(False).alias("left"))
    both = queries.unionByName(asked).select("key", (F.col("a") * 1_000_000 + F.col("b")).alias("part"), "node", "left")
    both = both.join(sets, "node").join(labels.select("node", "component"), "node")
    return among_small.union(join_groups(both, percent))


def jaccard_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set and the smallest doc_id that links reach.

    Two sets are linked when 100 * |both| >= percent * |either|. Null and empty texts have an empty set and are linked with nothing;
    equal sets are linked, sets exactly at the threshold too. Rows with a null doc_id get a null component and link nothing; repeated rows of a
    doc_id are one document each and share their components if their texts do. The set of a very long text is whole. An empty table gives
    none, other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), payload().alias("text"))
    with passing_tables() as keep:
        sets = keep(prefixes(texts, width, percent))
        known = sets.where("doc_id is not null and n > 0")
        nodes = cut(known.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id")))
        left = nodes.withColumn("name", short_name()).join(survivors(known, percent), "name").select("node", "digest", "doc_id")
        kept = kept_sets(texts, cut(left), width)
        keys = keys_of(kept, percent)
        labels = label(keys, cut(first_links(kept, keys, percent)))
        last = cut(last_links(kept, keys, labels, percent))
        # What was linked first is stars by now.
        forest = components(labels.select(F.col("component").alias("src"), F.col("node").alias("dst")).union(last.select("root", "node")))
        placed = cut(forest.join(nodes, "node"))
        least = cut(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")))
        found = nodes.select("node", "digest", "doc_id").join(placed.select("node", "root").join(least, "root"), "node", "left")
        # A row a set on the right; a set of many copies is a hot key that Spark can split.
        named = keep(cut(found.select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))))
    result = sets.select("doc_id", "n", "digest").join(named, "digest", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
