import zlib

import numpy as np
from cases import documents, texts
from pyspark.sql import functions as F

from marketloom.llm import toxicity
from marketloom.llm.langid import held_out

SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels, ~held_out(4, 2))
    scored = toxicity.score_texts(docs, model).join(labels, "doc_id").where(held_out(4, 2)).select("toxic", "score", "predicted").toPandas()
    order = np.argsort(scored.score.to_numpy())
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    bad = scored.toxic.to_numpy() == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.9
    assert scored.predicted[bad].mean() > 0.7 and scored.predicted[~bad].mean() < 0.05
    assert ((scored.score >= 0.3) == (scored.predicted == 1)).all()


def test_odd_rows_and_missing_labels(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (2, 1), (None, 1), (3, None), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    found = toxicity.score_texts(docs, model).collect()
    assert len(found) == len(texts()) and all(0 <= r.score <= 1 for r in found)
    by_text = {}
    for r in found:
        by_text.setdefault(r.doc_id, set()).add(r.score)
    assert by_text[300] == by_text[301]
    nothing = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert toxicity.score_texts(docs, nothing).where("predicted = 1").count() == 0
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    labels = spark.range(1000).selectExpr("id doc_id", "cast(id % 2 as int) toxic")
    assert toxicity.sample_labels(labels, F.lit(True), 100).count() == 100


def test_held_out_split(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), held_out(4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def plain_buckets(text: str | None) -> set[int]:
    """By single characters and grams, without the library's vectorised steps."""
    folded = " "
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        kept = "a" <= c <= "z" or "0" <= c <= "9" or ord(c) >= 128
        if kept or folded[-1] != " ":
            folded += c if kept else " "
    folded += " "
    found = set()
    for n in toxicity.ORDERS:
        for k in range(len(folded) - n + 1):
            key = n
            for c in folded[k : k + n]:
                key = (key * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            key = (key ^ key >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            key = (key ^ key >> 27) * 0x94D049BB133111EB % 2**64
            found.add((key ^ key >> 31) >> (64 - toxicity.BUCKET_BITS))
    return found


def plain_score(model, text: str | None) -> float:
    slots = {int(model.slot[b]) for b in plain_buckets(text)} - {-1}
    z = model.bias + sum(float(model.weight[k] * model.ratio[k]) for k in slots)
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def test_ngrams_are_of_characters():
    for text in ("", "a", "Stupid!! idiot 7", "ты глупец", "ηλίθιε", "你真是个笨蛋啊", "tu es bête 😀😀 x", "\x00é"):
        ids = toxicity.bucket_ids(text.encode())
        assert {int(x) for x in np.concatenate(ids)} == plain_buckets(text)
    assert [len(x) for x in toxicity.bucket_ids("глупец".encode())] == [4, 3]  # eight characters with the blanks
    assert [len(x) for x in toxicity.bucket_ids(b"\xff\xfeab")] == [2, 1]  # no UTF-8: two replacement characters


def test_fit_by_blocks_is_the_plain_fit(monkeypatch):
    rng = np.random.default_rng(5)
    dense = rng.random((40, 30)) < 0.3
    dense[7] = False
    labels, ratio = (rng.random(40) < 0.4).astype(float), rng.normal(size=30)
    features, offsets = np.flatnonzero(dense) % 30, np.concatenate([[0], np.cumsum(dense.sum(axis=1))])
    x, w, b = dense * ratio, np.zeros(30), np.log((labels.sum() + 1) / (40 - labels.sum() + 1))
    m, v = np.zeros(31), np.zeros(31)
    for t in range(1, toxicity.STEPS + 1):
        error = (1 / (1 + np.exp(-(x @ w + b))) - labels) / 40
        grad = np.append(x.T @ error + toxicity.RIDGE * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = toxicity.RATE * (1 - t / (toxicity.STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    w = toxicity.KEEP * w + (1 - toxicity.KEEP) * np.abs(w).mean()
    for size in (1, 25, 1 << 20):
        monkeypatch.setattr(toxicity, "FIT_FEATURES", size)
        weight, bias = toxicity.fit_linear(features.astype(np.int16), offsets, labels, ratio)
        assert np.allclose(weight, w, atol=1e-6) and abs(bias - b) < 1e-6


def test_fit_unfolds_no_more_than_a_block(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(toxicity, "STEPS", 2)
    peaks = []
    for n in (500, 2000):
        features, offsets = np.tile(np.arange(8192, dtype=np.int16), n), np.arange(n + 1) * 8192
        tracemalloc.start()
        toxicity.fit_linear(features, offsets, np.arange(n) % 2.0, np.ones(8192))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.1 * peaks[0] < 64 << 20


def test_query_against_plain_scoring(spark):
    from marketloom.llm.queries import queries

    small = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.train(docs, labels, ~held_out(4, 2))
    text = {r.doc_id: r.text for r in docs.collect()}
    found = queries()["op6_toxicity"](spark, small).collect()
    assert len(found) == len(text)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert abs(r.score - plain_score(model, text[r.doc_id])) < 1e-9 and r.predicted == (r.score >= 0.3)


def test_repeated_rows_of_an_id_count_once(spark):
    docs = documents(spark, [(k, f"text {k} of {'nasty' if k % 2 else 'friendly'} words", "en", "s") for k in range(8)] + [(0, "text 0 of friendly words", "en", "s")] * 300)
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    once = toxicity.train(docs.distinct(), labels, F.lit(True))
    again = toxicity.train(docs, labels, F.lit(True))
    assert (once.slot >= 0).any() and (once.slot == again.slot).all() and (once.weight == again.weight).all() and once.bias == again.bias
