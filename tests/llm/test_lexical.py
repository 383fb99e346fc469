"""Best-first search in max trees against scoring every document for every item."""

import math
import random

import numpy as np
import pytest
from cases import alnum_words, documents, texts

from marketloom.llm import lexical
from marketloom.llm.lexical import MaxTree, ShardBuilder, rank_documents


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score) of (doc_id, text) and (item_id, text)."""
    held = [(i, alnum_words(t)) for i, t in docs]
    held = [(i, w, {x: w.count(x) for x in set(w)}) for i, w in held if w]
    total = sum(len(w) for _, w, _ in held)
    df = {}
    for _, _, counts in held:
        for x in counts:
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(alnum_words(t))
    for item, terms in asked.items():
        found = []
        for i, w, counts in held:
            m = 100 - 90 + (90 * len(w) * len(held)) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in terms if t in counts)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1):
            yield item, rank, i, -score


def items_of(rng):
    rows = [(k, " ".join(rng.choice(["alpha", "Beta", "gamma", "mu", "xi", "漢字", "ελληνικά", "nowhere"]) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 30)))) for k in range(12)]
    return rows + [(20, None), (21, " .,!"), (22, "This very line is shared by many of the documents."), (23, "one ONE two"), (23, "two x"), (None, "漢字 ελληνικά ä alpha3"), (24, "alpha1"), (24, "alpha1")]


@pytest.mark.parametrize("block_bytes, parts", [(1 << 20, 1), (300, 4)])
def test_against_plain(spark, block_bytes, parts):
    given, items = texts(), items_of(random.Random(4))
    docs = documents(spark, given).repartition(parts)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = rank_documents(docs, asked, block_bytes=block_bytes).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain([r[:2] for r in given], items)))
    assert found and {r.item_id for r in found if r.doc_id is None} != set()


def test_copies_tie_by_id(spark):
    given = [(k, "same words here", None, None) for k in range(300, 0, -1)] + [(1000 + k, "other text", None, None) for k in range(50)]
    found = rank_documents(documents(spark, given).repartition(5), spark.createDataFrame([("a", "here"), ("b", "absent")], "item_id string, text string")).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(found, key=lambda r: r["rank"])] == [("a", k, k) for k in range(1, 11)]


def test_empty_tables(spark):
    docs, none = documents(spark, texts()), documents(spark, [])
    items = spark.createDataFrame([(1, "alpha1")], "item_id long, text string")
    assert rank_documents(none, items).collect() == [] and rank_documents(docs, items.limit(0)).collect() == []
    assert rank_documents(documents(spark, [(1, None, None, None), (2, "", None, None)]), items).collect() == []


def test_tree_opens_few_ranges_and_bounds_hold():
    rng = random.Random(6)
    vocabulary = {f"w{k}".encode(): k for k in range(1, 400)}
    builder = ShardBuilder(vocabulary)
    for i in range(3000):
        builder.add(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(5, 80))).encode())
    n_docs, n_terms = builder.n_docs, builder.n_terms
    tree = MaxTree(builder.row().to_pylist()[0], n_docs, n_terms, len(vocabulary))
    assert len(tree.levels) == 3 and [m.shape[1] for m in tree.levels] == [47, 6, 1]
    for level in (1, 2):
        assert (tree.levels[level].max(axis=1) == tree.levels[0].max(axis=1)).all()
    weights = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    weights[tree.slot >= 0] = 1 + 400 * np.arange((tree.slot >= 0).sum())
    few = 0
    for _ in range(20):
        terms = np.array(sorted(rng.sample(range(1, 400), 6)), dtype=np.int64)
        best: list = []
        few += tree.search(terms, weights[terms], best, 10) < 47
        slots = tree.slot[terms]
        scores = np.concatenate([tree.scores(slots[slots >= 0], weights[terms][slots >= 0], r) for r in range(47)])[:3000]
        want = sorted(((-int(s), tree.ids[k]) for k, s in enumerate(scores) if s > 0))[:10]
        assert sorted((-s, -i) for s, _, i in best) == want
    assert few >= 15


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE_BYTES", 50)
    text = ("word " * 40 + "x" * 300 + "!tail").encode()
    assert b"".join(lexical.pieces(text)) == text
    assert [w for p in lexical.pieces(text) for w in lexical.TERM_BYTES.findall(p)] == lexical.TERM_BYTES.findall(text)
