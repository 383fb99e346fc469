"""The manifest by supersteps against a plain tree, at every number of levels a vertex may hash by itself."""

import random
from hashlib import sha256

import pytest
from cases import documents, texts
from pyspark.sql import functions as F

from marketloom.llm import merkle

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(values) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes: list[str]):
    """The root of a list and each one's path of runs, by hashing runs of three."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 3 * 3 : p // 3 * 3 + 3]
            paths[k].append((run[: p % 3], run[p % 3 + 1 :]))
        nodes = [H(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return nodes[0], paths


def plain(rows, changed):
    """(doc_id, leaf, subroot, root, proof, folded root) of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append((r[0] is not None, r[0] or 0, leaf(r), leaf(changed(r)), r[0]))
    names = sorted(groups)
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = climb([trees[g][0] for g in names])
    for g, over in zip(names, above):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            now = x[3]
            for left, right in path + over:
                now = H(*left, now, *right)
            yield x[4], x[2], trees[g][0], root, H(*(s for left, right in path + over for s in (*left, *right))), now


def rows_of(docs):
    return [tuple(r) for r in docs.select(*FIELDS).collect()]


def cases():
    rng = random.Random(5)
    yield "awkward", texts()
    yield "one", [(7, "only one", "en", "src0")]
    yield "groups", [(k, f"text\n{k}", None, rng.choice([None, "", "s", "ä", "z", "src1", "src10", "src2"])) for k in range(90)]
    yield "hot", [(k % 50, "a\nb", "en", "src0") for k in range(400)] + [(k, None, None, f"g{k}") for k in range(30)]


@pytest.mark.parametrize("levels", [1, 2, 6])
@pytest.mark.parametrize("name, given", list(cases()))
def test_against_plain(spark, name, given, levels):
    docs = documents(spark, given).repartition(3)
    changed = lambda r: (*r[:4], r[4] and r[4].replace("\n", ""))
    seen = merkle.leaf_of([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS])
    found = merkle.manifest(docs, FIELDS, "source", "doc_id", seen=seen, levels=levels).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain(rows_of(docs), changed)))
    assert any(r.folded_root != r.root for r in found) or name == "one"


def test_untouched_rows_verify_and_clashing_names(spark):
    docs = documents(spark, texts()).withColumns({c: F.lit("x") for c in ("tree", "order", "leaf", "seen", "tie", "at", "part", "pos", "total")})
    found = merkle.manifest(docs, FIELDS, "source", "doc_id").collect()
    assert len(found) == docs.count() and all(r.folded_root == r.root for r in found) and len({r.root for r in found}) == 1


def test_empty_table(spark):
    assert merkle.manifest(documents(spark, []), FIELDS, "source", "doc_id").collect() == []
