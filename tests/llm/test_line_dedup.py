import hashlib

import numpy as np
from cases import documents, line_dedup, texts

from marketloom.llm import bloom
from marketloom.llm.line_dedup import dedup_lines


def test_against_brute_force(spark):
    docs = documents(spark)
    found = dedup_lines(docs)
    assert found.columns == [*docs.columns, "__n_lines", "__n_dropped", "__kept_sha256"]
    rows = [(i, t) for i, t, *_ in texts()]
    want = sorted((i is None, i or 0, n, d, hashlib.sha256(kept.encode()).hexdigest()) for (i, _), (n, d, kept) in zip(rows, line_dedup(rows)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r["__n_lines"], r["__n_dropped"], r["__kept_sha256"]) for r in found.collect()) == want
    assert sum(w[3] for w in want) == 7  # six documents share the line, three the base text
    assert found.where("text is null").count() == 2 and found.where("`a.b` = 3").count() == len(rows)


def test_ties_limits_and_empty_table(spark):
    line = "ten words "
    rows = [(1, line * 2), (1, line * 2), (2, f" {line.upper() * 2}\n{line * 2}\nshort"), (3, "ü" * 19 + "\nshort"), (4, "ü" * 19), (5, "ü" * 19), (6, "Ü" * 20), (7, "Ü" * 20), (8, "Ü" * 20)]
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    found = sorted((r.doc_id, r["__n_dropped"]) for r in dedup_lines(docs).collect())
    assert found == [(1, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1), (7, 1), (8, 0)]
    assert dedup_lines(documents(spark, [])).count() == 0


def test_filter_misses_no_repeat(spark):
    values = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    rows = [(bytearray(v.tobytes()),) for v in [*values, *values[:300]]]
    texts = spark.createDataFrame(rows, "text binary").repartition(5)
    bits = bloom.twice_seen(texts, bloom.filter_bits(5300), lambda parts: np.frombuffer(b"".join(parts), np.uint64))
    assert bloom.holds(bits, values[:300]).all() and bloom.holds(bits, values[300:]).mean() < 0.1
