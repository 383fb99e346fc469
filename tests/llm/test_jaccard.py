import random
import uuid
from collections import Counter

import numpy as np
from cases import components, documents, shingles, texts, words
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import jaccard, text


def expected(rows):
    sets: dict[int, list] = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(text))
    return Counter((i, len(s), c) for i, own in sets.items() for s, c in zip(own, components(sets)[i]))


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect() if r.doc_id is not None)


def test_against_all_pairs(spark):
    assert found(documents(spark)) == expected([(i, t) for i, t, *_ in texts()])
    nulls = [r for r in jaccard.jaccard_components(documents(spark)).collect() if r.doc_id is None]
    assert [r.component_id for r in nulls] == [None, None]
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0


def test_chains_passages_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_NODES", 8)  # so that groups are dealt to parts and blocks
    monkeypatch.setattr(jaccard, "LARGE_NODES", 6)
    rng = random.Random(3)
    base, passage = words(rng, 60).split(), words(rng, 40)
    rows = []
    for k in range(60):  # a long chain of near copies
        base[rng.randrange(60)] = f"new{k}"
        rows.append((k, " ".join(base)))
    rows += [(100 + k, f"{words(rng, 9)} {passage}") for k in range(40)]  # just below and above the threshold
    rows += [(200 + k, f"{words(rng, 4 + k % 3)} {passage}") for k in range(30)]
    rows += [(300 + k, words(rng, rng.randrange(1, 8))) for k in range(30)]
    assert found(documents(spark, [(i, t, None, None) for i, t in rows])) == expected(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 14), min_size=1), min_size=1, max_size=70), st.booleans())
def test_tree_finds_every_link(groups, some):
    sets = [np.array(sorted(g), dtype=np.uint64) for g in groups]
    left = np.arange(len(sets)) % 3 == 0 if some else None
    root = jaccard.join_tree(sets, 80, left)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(groups[a] & groups[b]) >= 80 * len(groups[a] | groups[b]) and (left is None or left[a] or left[b]):
                parent[find(a)] = find(b)
    same = lambda r: {(a, b) for a in range(len(r)) for b in range(a) if r[a] == r[b]}
    wanted = same([find(i) for i in range(len(sets))])
    assert wanted == same(root) if left is None else wanted <= same(root)


def test_known_links_are_kept():
    sets = [np.array([k], dtype=np.uint64) for k in range(4)]
    root = jaccard.join_tree(sets, 80, None, [7, None, 7, None])
    assert root[0] == root[2] and len(set(root)) == 3


def test_tables_of_a_run_are_deleted(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(text, "shared_folder", lambda _: f"file://{tmp_path}/{uuid.uuid4().hex}")
    docs = documents(spark, [(1, "a b c d e f", None, None), (2, "a b c d e f", None, None), (3, "other words than those of before", None, None)])
    found = jaccard.jaccard_components(docs)
    assert len(list(tmp_path.iterdir())) == 2  # sets and their components, which the result reads
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_components_of_stars_need_no_round(spark, monkeypatch):
    """Edges and least neighbours are written, then it is seen that nothing is left to do; paths still need rounds."""
    from marketloom.llm import components as c

    written, cut = [], c.cut
    monkeypatch.setattr(c, "cut", lambda df: written.append(1) or cut(df))
    stars = [(k % 3, k) for k in range(3, 30)]
    found = c.components(spark.createDataFrame(stars, "src long, dst long")).collect()
    assert sorted((r.node, r.root) for r in found) == [(k, k % 3) for k in range(30)] and len(written) == 2
    path = c.components(spark.createDataFrame([(k, k + 1) for k in range(9)], "src long, dst long")).collect()
    assert sorted((r.node, r.root) for r in path) == [(k, 0) for k in range(10)]
