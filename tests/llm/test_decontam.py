import hashlib

import numpy as np
from cases import alnum_words, decontaminate, documents, texts, words
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import decontam


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=120), st.lists(st.lists(st.integers(2, 5), min_size=1, max_size=4), min_size=1, max_size=5))
def test_fm_index(symbols, windows):
    text = np.array([*symbols, 0], dtype=np.int64)
    index = decontam.FMIndex(text, 6)
    table = np.zeros((len(windows), 4), dtype=np.int64)
    for k, w in enumerate(windows):
        table[k, : len(w)] = w
    low, high = index.search(table, np.array([len(w) for w in windows]))
    for w, a, z in zip(windows, low, high):
        want = [k for k in range(len(symbols)) if symbols[k : k + len(w)] == w]
        assert sorted(index.locate(np.arange(a, z)).tolist()) == want


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def items_of(rows):
    return {str(i): t for i, t in rows}


def test_against_brute_force(spark):
    import random

    rng = random.Random(9)
    items = [(k, words(rng, 25)) for k in range(8)] + [(20, "Tiny item"), (21, None), (22, "!!"), (23, words(rng, 10)), (24, items_dup := words(rng, 12)), (25, items_dup)]
    rows = texts()
    for k in range(12):
        a = items[k % 8][1].split()
        rows.append((700 + k, f"{words(rng, 20)} {' '.join(a[k : k + 8 + k % 5]).upper()}! {words(rng, 5)} a tiny, ITEM", "en", "src0"))
    rows.append((720, items_dup + " " + items_dup, "en", "src0"))
    found = decontam.digest_hits(decontam.search_benchmark(documents(spark, rows), bench(spark, items))).collect()
    want = []
    for i, text, *_ in rows:
        w, hit, owners = decontaminate(text, items_of(items))
        want.append((i is None, i or 0, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == sorted(want)
    assert sum(x[-1] for x in want) >= 12


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = documents(spark), bench(spark, [(k, t) for k, (_, t, *_) in enumerate(texts()[:6])])
    once = sorted(map(tuple, decontam.digest_hits(decontam.search_benchmark(docs, items)).collect()), key=repr)
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 40)
    assert sorted(map(tuple, decontam.digest_hits(decontam.search_benchmark(docs, items)).collect()), key=repr) == once


def test_removal_leaves_no_window(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "left right")]
    bodies = {1: "Start one two three four five six seven eight nine ten eleven, end.", 2: "keep me whole", 3: "left left right right", 4: None, 5: ""}
    docs = documents(spark, [(i, t, "en", "s") for i, t in bodies.items()])
    found = {r.doc_id: r for r in decontam.decontaminate(docs, bench(spark, items)).collect()}
    assert alnum_words(found[1].text) == ["start", "end"] and found[1]["__n_cut"] == 11
    assert found[2].text == bodies[2] and found[4].text is None and found[5].text == "" and not found[3].text.strip()
    assert found[1]["a.b"] == 3
    assert decontam.decontaminate(docs, bench(spark, [])).where("__n_cut > 0").count() == 0
    assert decontam.decontaminate(docs.limit(0), bench(spark, items)).count() == 0
    assert decontam.search_benchmark(docs, bench(spark, [])).where("n_hit > 0 or n_words is null").count() == 0


def test_removal_by_blocks_of_items_gives_the_same(spark, monkeypatch):
    w = [f"w{k}" for k in range(1, 26)]
    items = bench(spark, [(1, " ".join(w[:10])), (2, " ".join(w[5:15])), (3, " ".join(w[15:25])), (4, "left right")])
    docs = documents(spark, [(1, " ".join(w[:15]), "en", "s"), (2, f"start {', '.join(w)}; end", "en", "s"), (3, "left left w16 right right", "en", "s"), (4, "keep me", "en", "s")])
    once = sorted((r.doc_id, r.text, r["__n_cut"]) for r in decontam.decontaminate(docs, items).collect())
    spans = sorted((r.doc_id, r.spans) for r in decontam.search_benchmark(docs, items).collect())
    assert [n for _, _, n in once] == [15, 25, 0, 0] and alnum_words(once[1][1]) == ["start", "end"]
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 2)
    assert sorted((r.doc_id, r.text, r["__n_cut"]) for r in decontam.decontaminate(docs, items).collect()) == once
    assert sorted((r.doc_id, r.spans) for r in decontam.search_benchmark(docs, items).collect()) == spans


def test_one_index_a_shard_however_many_blocks(monkeypatch):
    import random

    rng = random.Random(4)
    items = [(str(k), words(rng, 14)) for k in range(12)]
    rows = [f"{words(rng, 40)} {items[k % 12][1]} {words(rng, 9)} {items[(k + 5) % 12][1][:60]}".encode() for k in range(30)]
    windows = [(w, i) for i, text in items for w in decontam.item_windows(text.encode(), 10)]
    built = []
    plain = decontam.FMIndex
    monkeypatch.setattr(decontam, "FMIndex", lambda *x: built.append(1) or plain(*x))
    monkeypatch.setattr(decontam, "SHARD_BYTES", sum(map(len, rows)) // 3)
    found = []
    for n in (1, 7, 20):
        built.clear()
        found.append(decontam.find_hits(rows, decontam.Blocks([decontam.Phrases.of(windows[k::n], 10) for k in range(n)])))
        assert len(built) == 4  # shards
    assert found[0] == found[1] == found[2]
    for text, (n_words, hit, owners, _) in zip(rows, found[0]):
        w, at, have = decontaminate(text.decode(), dict(items))
        assert (n_words, hit, owners) == (len(w), len(at), sorted(have))
