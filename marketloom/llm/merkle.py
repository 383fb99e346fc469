"""Merkle manifest of a dataset by RDD supersteps.

Each row is a leaf; the leaves of a group ascend by their order; every FAN consecutive nodes become their hash, the last run
with fewer (even one), until one node is left, the group's subroot. Subroots, ordered by group (null first, then bytewise), likewise give the root.

Vertices are blocks of FAN ** levels consecutive nodes. In a superstep children message their vertex; a vertex that has all it
waits for hashes its levels and forwards one digest upward. When the root is known, supersteps run in reverse: a vertex
receives the siblings on its path to the root and hands each child the path that is longer by the child's own siblings. Leaves
so get a proof, and are folded to a root again. A group of any size is blocks of bounded size; the number of supersteps is the
logarithm of the largest group, and each vertex's state is written to the shared folder, so that what an executor loses is read again.

Null, empty and very long values are hashed as they are; rows of one order follow each other by their digest, so repeated rows
are leaves of their own; rows with a null order come first, those of a null group are a group. An empty table has no rows and
no root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.text import cut, passing_tables, quoted, remove, shared_folder

FAN = 3
#: Levels that a vertex hashes by itself: it has FAN ** LEVELS children at most.
LEVELS = 6
#: The tree above the groups; those are "" (null) or begin with "s".
TOP = "t"
PROVED = "order {order}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"

Key = tuple[str, int, int]  # tree, superstep, block
#: Siblings of a node and of those above it, level by level: what is left and right of it in its run.
Path = tuple[tuple[str, str], ...]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of values: `-` for null, else the UTF-8 bytes' count, a colon and the value, one after the other."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds pos, the 0-based place of a row within its `tree` by `order`, and total, the tree's rows. Ranges are sorted; only their counts are summed up."""
    sides = [F.col(c).asc_nulls_first() for c in ("tree", *order, "tie")]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*sides).sortWithinPartitions(*sides).drop("tie")
    held = cut(ranged.withColumn("at", F.monotonically_increasing_id())).withColumns({"part": F.shiftrightunsigned("at", 33), "at": F.col("at").bitwiseAND(2**33 - 1)})
    counts = held.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # a row for each range and tree that meet
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("tree", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("start"), F.sum("n").over(Window.partitionBy("tree")).alias("total")))
    return held.join(starts, ["tree", "part"]).withColumn("pos", F.col("start") + F.col("at")).drop("start", "at", "part")


def nodes_at(total: int, step: int, levels: int) -> int:
    """Nodes of a tree of `total` leaves that are children in a superstep."""
    size = FAN ** (levels * step)
    return -(-total // size)


def last_step(total: int, levels: int) -> int:
    """The superstep in which a tree has one vertex."""
    step = 0
    while nodes_at(total, step, levels) > FAN**levels:
        step += 1
    return step


def where(key: Key) -> int:
    """A partition of a vertex, the same in every process."""
    return zlib.crc32(f"{key[1]}/{key[2]}/{key[0]}".encode())


def hashed(vertex: tuple[Key, Iterator[tuple]], levels: int) -> tuple[Key, tuple]:
    """A vertex that has heard from its children: (total, levels of digests below its own, what came with the children, own digest)."""
    key, messages = vertex
    children = sorted(messages, key=lambda m: m[0])
    total = children[0][1]
    nodes = nodes_at(total, key[1], levels)
    if len(children) != min(FAN**levels, nodes - key[2] * FAN**levels):
        raise ValueError(f"vertex {key} has heard from {len(children)} children")
    now, below = [m[2] for m in children], []
    for _ in range(levels):
        if nodes <= 1:
            break
        below.append(now)
        now = [digest("".join(now[k : k + FAN])) for k in range(0, len(now), FAN)]
        nodes = -(-nodes // FAN)
    return key, (total, below, [m[3] for m in children], now[0])


def forwarded(vertex: tuple[Key, tuple], levels: int) -> tuple[Key, tuple]:
    """The message of a vertex to its parent."""
    (tree, step, block), (total, _, _, own) = vertex
    return (tree, step + 1, block // FAN**levels), (block % FAN**levels, total, own, None)


def siblings(below: list[list[str]], child: int) -> Path:
    """The path of a child within its vertex."""
    out = []
    for nodes in below:
        start = child // FAN * FAN
        out.append(("".join(nodes[start:child]), "".join(nodes[child + 1 : start + FAN])))
        child //= FAN
    return tuple(out)


class Supersteps:
    """Runs supersteps over keyed vertices; what a superstep leaves behind is a file of the shared folder."""

    def __init__(self, spark, levels: int):
        self.spark, self.levels, self.paths = spark, levels, []
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def written(self, rdd: RDD) -> RDD:
        self.paths.append(shared_folder(self.spark))
        rdd.saveAsPickleFile(self.paths[-1])
        return self.spark.sparkContext.pickleFile(self.paths[-1])

    def upward(self, leaves: RDD, largest: int) -> list[RDD]:
        """Vertices of each superstep. leaves: (tree, total, pos, digest, anything)."""
        levels = self.levels
        block = FAN**levels
        messages = leaves.map(lambda r: ((r[0], 0, r[2] // block), (r[2] % block, r[1], r[3], r[4])))
        steps = []
        for step in range(last_step(largest, levels) + 1):
            heard = messages.groupByKey(self.parts, where)  # a vertex has FAN ** levels children at most
            steps.append(self.written(heard.map(lambda v: hashed(v, levels))))
            messages = steps[-1].filter(lambda v, step=step: step < last_step(v[1][0], levels)).map(lambda v: forwarded(v, levels))
        return steps

    def subroots(self, steps: list[RDD]) -> RDD:
        """(tree, total, digest) of each tree, from the superstep that was its last."""
        levels = self.levels
        ends = [s.filter(lambda v, step=step: step == last_step(v[1][0], levels)).map(lambda v: (v[0][0], v[1][0], v[1][3])) for step, s in enumerate(steps)]
        return self.spark.sparkContext.union(ends)

    def downward(self, steps: list[RDD], above: RDD) -> RDD:
        """(what came with a leaf, its digest, path, subroot, root). above: (key, (path, subroot, root)) of the last vertex of each tree."""
        block = FAN**self.levels

        def children(item: tuple[Key, tuple[tuple, tuple]]) -> Iterator[tuple]:
            (tree, step, index), ((_, below, extras, own), (path, subroot, root)) = item
            for child, extra in enumerate(extras):
                further = siblings(below, child) + path
                if step:
                    yield (tree, step - 1, index * block + child), (further, subroot, root)
                else:
                    yield extra, below[0][child] if below else own, further, subroot, root

        messages = None
        for step in range(len(steps) - 1, -1, -1):
            own = above.filter(lambda m, step=step: m[0][1] == step)
            messages = own if messages is None else messages.union(own)
            messages = joined(steps[step], messages, self.parts).flatMap(children)
        return messages


def joined(vertices: RDD, messages: RDD, parts: int) -> RDD:
    """(key, (state, message)) of vertices with their one message."""
    both = vertices.mapValues(lambda v: (0, v)).union(messages.mapValues(lambda m: (1, m))).groupByKey(parts, where)
    return both.mapValues(lambda pair: [x for _, x in sorted(pair, key=lambda x: x[0])])


def fold(seen: str, path: Path) -> str:
    """The root that a leaf and the siblings on its path give."""
    for left, right in path:
        seen = digest(left + seen + right)
    return seen


def proof_of(path: Path) -> str:
    return digest("".join(left + right for left, right in path))


def manifest(docs: DataFrame, fields: Sequence[str], group: str, order: str, seen: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root) of each row.

    leaf: digest of the row's fields; proof_sha256: digest of the siblings on its path to the root; folded_root: what `seen` (a digest
    of the row as it is found now; the leaf by default) and those siblings give, so a row is as it was where that equals root.
    """
    spark = docs.sparkSession
    leaf = leaf_of([quoted(c) for c in fields])
    tree = F.when(quoted(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), quoted(group).cast("string")))
    rows = docs.select(tree.alias("tree"), quoted(order).alias("order"), leaf.alias("leaf"), (leaf if seen is None else seen).alias("seen"))
    schema = PROVED.format(order=docs.schema[order].dataType.simpleString())
    run = Supersteps(spark, levels)
    with passing_tables() as keep:
        leaves = cut(placed(rows, ["order", "leaf"]))
        largest = leaves.agg(F.max("total")).first()[0] or 1
        given = leaves.select("tree", "total", "pos", "leaf", "order", "seen").rdd.map(lambda r: (r[0], r[1], r[2], r[3], (r[4], r[5])))
        steps = run.upward(given, largest)
        tops = spark.createDataFrame(run.subroots(steps), "of string, size long, leaf string", verifySchema=False).withColumn("tree", F.lit(TOP))
        groups = cut(placed(tops, ["of"]))
        over = run.upward(groups.select("tree", "total", "pos", "leaf", "of", "size").rdd.map(lambda r: (r[0], r[1], r[2], r[3], (r[4], r[5]))), groups.count() or 1)
        roots = run.subroots(over).map(lambda r: ((TOP, last_step(r[1], levels), 0), ((), r[2], r[2])))
        above = run.downward(over, roots).map(lambda x: ((x[0][0], last_step(x[0][1], levels), 0), (x[2], x[1], x[4])))
        proofs = run.downward(steps, run.written(above)).map(lambda x: (x[0][0], x[1], x[3], x[4], proof_of(x[2]), fold(x[0][1], x[2])))
        out = keep(cut(spark.createDataFrame(proofs, schema, verifySchema=False)))
    for path in run.paths:
        remove(spark, path)
    return out
