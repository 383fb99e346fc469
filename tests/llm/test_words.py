"""Words that collide under every polynomial hash modulo 2**64 are different words to every operator."""

import numpy as np
from cases import documents

import corpus_pipeline
from marketloom.llm import decontam, jaccard
from marketloom.llm.suffix_dedup import dedup_strings
from marketloom.llm.text import NOT_ALNUM, SPACE, fold_table, word_hashes


def thue_morse(n: int, letters: str) -> str:
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


ONE, OTHER = thue_morse(2048, "ab"), thue_morse(2048, "ba")
COMMON = "alpha beta gamma delta epsilon zeta eta theta iota"


def test_hashes_differ():
    for n in (64, 1024, 2048, 4096):
        hashes = word_hashes([thue_morse(n, "ab").encode(), thue_morse(n, "ba").encode()], fold_table(SPACE))[0]
        assert hashes[0] != hashes[1]


def test_places_and_folding():
    rows = [b"", b" One  TWO", "äÄx,y".encode(), b"x" * 10, b"\x1c1"]
    hashes, first, starts, ends = word_hashes(rows, fold_table(NOT_ALNUM))
    joined = b" ".join(rows)
    assert [joined[a:b] for a, b in zip(starts, ends)] == [b"One", b"TWO", "äÄx".encode(), b"y", b"x" * 10, b"1"]
    assert first.tolist() == [0, 0, 2, 4, 5, 6] and hashes[0] == word_hashes([b"one"], fold_table(SPACE))[0][0]
    many = [b"w%d" % (k % 1000) for k in range(200_000)]
    assert len(np.unique(word_hashes([b" ".join(many)], fold_table(SPACE))[0])) == 1000


def test_jaccard(spark):
    docs = documents(spark, [(1, ONE, None, None), (2, OTHER, None, None), (3, f"{COMMON} {ONE}", None, None), (4, f"{COMMON} {ONE}", None, None)])
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()) == [(1, 1), (2, 2), (3, 3), (4, 3)]
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect()) == [1, 2, 3]


def test_decontamination(spark):
    docs = documents(spark, [(1, f"x {ONE} y", None, None), (2, f"x {OTHER} y", None, None), (3, f"{COMMON} {OTHER} end", None, None)])
    items = spark.createDataFrame([(1, ONE), (2, f"{COMMON} {ONE}")], "item_id long, text string")
    assert sorted((r.doc_id, r.n_hit, r["items"]) for r in decontam.search_benchmark(docs, items).collect()) == [(1, 1, ["1"]), (2, 0, []), (3, 0, [])]
    assert {r.doc_id: r.text for r in decontam.decontaminate(docs, items).collect()} == {1: "x   y", 2: f"x {OTHER} y", 3: f"{COMMON} {OTHER} end"}


def test_hits_of_equal_hashes_are_confirmed(monkeypatch):
    """With a hash that knows a word's length only, every window of like lengths is found and must be told apart by its words."""
    plain = decontam.word_hashes

    def by_length(rows, table):
        _, first, starts, ends = plain(rows, table)
        return (ends - starts).astype(np.uint64), first, starts, ends

    monkeypatch.setattr(decontam, "word_hashes", by_length)
    phrases = decontam.Phrases.of([(b"aa bb", "1"), (b"cc dd", "2"), (b"aa bb", "3")], 10)
    found = decontam.find_hits([b"xx AA, bb cc cc dd", b"dd cc"], decontam.Blocks([phrases]))
    assert [(hit, items) for _, hit, items, _ in found] == [(4, ["1", "2", "3"]), (0, [])]


def test_repeated_passages(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    docs = documents(spark, [(1, f"{passage} {ONE}", None, None), (2, f"{passage[:-4]} {OTHER}", None, None)])
    assert {r.doc_id: r.n_passage_words for r in dedup_strings(docs).collect()} == {1: 59, 2: 59}
