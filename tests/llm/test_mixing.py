import struct

import numpy as np
import pytest
import xxhash
from cases import alnum_words, documents, texts
from pyspark.sql import functions as F

from marketloom.llm import mixing
from marketloom.llm.mixing import Cells, Targets
from marketloom.llm.text import BATCH_ROWS, BATCH_SETTING, DEFAULT_BATCH_ROWS


def classical(tokens, targets, rounds=3000):
    """Plain proportional fitting, one cell at a time."""
    w = tokens.astype(float).copy()
    for _ in range(rounds):
        for axis, wanted in enumerate(targets):
            for k in range(len(wanted)):
                part = [slice(None)] * 3
                part[axis] = k
                total = w[tuple(part)].sum()
                if total > 0:
                    w[tuple(part)] *= wanted[k] * tokens.sum() / total
    return w


def test_raking_meets_targets():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 1000, (4, 3, 5)).astype(float)
    targets = [x / x.sum() for x in (rng.uniform(1, 2, 4), rng.uniform(1, 2, 3), rng.uniform(1, 2, 5))]
    cells = Cells([[], [], []], np.indices(tokens.shape).reshape(3, -1), tokens.ravel(), targets)
    factor = mixing.rake(cells, tokens.sum())
    for share, wanted in zip(mixing.achieved(cells, factor), targets):
        assert np.allclose(share, wanted, atol=1e-7)
    assert np.allclose(tokens * factor.reshape(tokens.shape), classical(tokens, targets), rtol=1e-6)
    capped = mixing.rake(cells, tokens.sum() * 0.5, 1.0)
    assert capped.max() <= 1 and abs((cells.tokens * capped).sum() / tokens.sum() - 0.5) < 0.05


def test_documents(spark):
    targets = Targets(source={"src0": 1.0, "src1": 1.0, "absent": 5.0}, lang={"en": 0.5, "de": 0.5})
    found = mixing.mix_documents(documents(spark), targets).collect()
    rows = texts()
    assert len(found) == len(rows)
    assert sorted(r.n_tokens for r in found) == sorted(len(alnum_words(t)) for _, t, *_ in rows)
    silent = [r for r in found if r.n_tokens == 0]
    assert silent and all((r.topic, r.weight, r.probability) == (None, 1.0, 0.5) for r in silent)
    assert all(0 <= r.probability <= 1 and r.weight > 0 for r in found if r.n_tokens)
    total = sum(r.n_tokens for r in found)
    assert sum(r.n_tokens * r.weight for r in found) == pytest.approx(total, rel=1e-3)
    assert sum(r.n_tokens * r.probability for r in found) <= total * 0.51
    again = mixing.mix_documents(documents(spark).repartition(7), targets).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert mixing.mix_documents(documents(spark, []), targets).count() == 0


def test_margins_and_sample_of_a_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    targets = Targets(source={f"src{k}": 1.0 for k in range(20)}, lang={"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15})
    found = mixing.mix_documents(docs, targets, 0.3).cache()
    total = found.agg(F.sum("n_tokens")).first()[0]
    share = {r.topic: r.n / total for r in found.groupBy("topic").agg(F.sum("n_tokens").alias("n")).collect() if r.topic}
    lifted = {k: x**0.5 / sum(y**0.5 for y in share.values()) for k, x in share.items()}
    assert len(share) == mixing.TOPICS and max(share.values()) < 0.8
    for name, wanted in (("source", {f"src{k}": 0.05 for k in range(20)}), ("lang", targets.lang), ("topic", lifted)):
        for r in found.groupBy(name).agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("p"), F.sum(F.when(F.col("sampled"), F.col("n_tokens"))).alias("s")).collect():
            if r[name] is not None:
                assert r.p / total / 0.3 == pytest.approx(wanted[r[name]], rel=1e-4)
                assert r.s / r.p == pytest.approx(1, abs=0.35)


def test_bounds():
    with pytest.raises(ValueError):
        Targets(source={"a": -1.0}, lang={})
    assert len(Targets(source={str(k): 1.0 for k in range(200_000)}, lang={"en": 1.0}).source) == 200_000  # only cells that have tokens are kept


def test_against_brute_force(spark):
    """Topics, cells, weights and draws of the registered query's targets in plain Python, with the model that was learnt."""
    from marketloom.llm.queries import MIX_FRACTION, MIX_TARGETS

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = mixing.learn_topics(docs, MIX_TARGETS.lang)
    want, tokens = [], {}
    for r in docs.collect():
        words = alnum_words(r.text)
        group = f"={r.lang}" if r.lang in MIX_TARGETS.lang else ""
        topic = None
        if words:
            counts = np.zeros(4096, dtype=np.float32)
            for w in words:
                counts[int(mixing.word_hashes([w.encode()], mixing.fold_table(mixing.NOT_ALNUM))[0][0]) >> 52] += 1
            x = np.sqrt(counts) * model.idf
            x = x / np.linalg.norm(x) - model.means[group]
            near = [float(np.dot(c, x / np.linalg.norm(x))) for c in model.centroids[group]]
            topic = str(max(range(len(near)), key=lambda k: (round(near[k], 6), -k)))
            cell = (r.source if r.source in MIX_TARGETS.source else None, r.lang if r.lang in MIX_TARGETS.lang else None, topic)
            tokens[cell] = tokens.get(cell, 0) + len(words)
        want.append((r.doc_id, r.source, r.lang, topic, len(words)))
    found = mixing.mix_documents(docs, MIX_TARGETS, MIX_FRACTION).collect()
    assert sorted(map(repr, ((r.doc_id, r.source, r.lang, r.topic, r.n_tokens) for r in found))) == sorted(map(repr, want))
    assert len({r.topic for r in found}) > 3
    dense = np.zeros([21, 5, 9])
    at = [{x: k for k, x in enumerate(mixing.named_values(MIX_TARGETS, n))} for n in mixing.DIMENSIONS]
    for cell, n in tokens.items():
        dense[tuple(a.get(x, len(a)) for a, x in zip(at, cell))] = n
    profile = mixing.profiles(docs, MIX_TARGETS.lang, model)
    cells = mixing.gather_cells(profile, MIX_TARGETS)
    assert {tuple(a): n for a, n in zip(cells.at.T.tolist(), cells.tokens.tolist())} == {a: dense[a] for a in map(tuple, np.argwhere(dense > 0).tolist())}
    exact = classical(dense, cells.targets)
    for r in found:
        cell = tuple(a.get(getattr(r, n), len(a)) for a, n in zip(at, mixing.DIMENSIONS))
        if r.n_tokens:
            assert r.weight == pytest.approx(exact[cell] / dense[cell], rel=1e-3, abs=1e-6)
        first = xxhash.xxh64_intdigest(r.key.encode(), seed=42)
        draw = (xxhash.xxh64_intdigest(struct.pack("<i", 17), seed=first) & ((1 << 52) - 1)) / (1 << 52)
        assert r.sampled == (draw < r.probability)


def directions(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lloyd(x, centroids):
    """Plain spherical k-means, clusters without rows dropped, larger ones first."""
    for _ in range(mixing.CLUSTER_ROUNDS):
        own = (x @ centroids.T).argmax(axis=1)
        order = sorted(set(own), key=lambda k: (-(own == k).sum(), k))
        centroids = directions(np.stack([x[own == k].sum(axis=0) for k in order]))
    return centroids


def test_topics_of_all_documents(spark):
    """Frequencies, means and centroids are those of every document: 1,600 of a language, with a topic that one in 40 has, and copies."""
    rng, docs = np.random.default_rng(5), []
    for k in range(1600):
        topic = 7 if k % 40 == 0 else k % 5
        words = [f"t{topic}w{x}" for x in rng.integers(0, 30, 40)] + [f"common{x}" for x in rng.integers(0, 50, 20)]
        docs.append((k, " ".join(words), "en" if k % 4 else "xx", "src0"))
    docs += [(2000 + k, *docs[3][1:]) for k in range(100)] + [(3000, None, "en", "src0"), (3001, "...", "en", "src0")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5)
    model = mixing.learn_topics(table, {"en": 1.0})
    told = [(f"={lang}" if lang == "en" else "", *next(mixing.word_counts([text.encode()]))) for _, text, lang, _ in docs if text not in (None, "...")]
    counts = np.zeros((len(told), mixing.DIMS))
    for row, (_, _, dims, n) in zip(counts, told):
        row[dims] = n
    idf = np.log((1 + len(told)) / (1 + (counts > 0).sum(axis=0))) + 1
    assert np.allclose(model.idf, idf)
    x = np.sqrt(counts) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    starts = mixing.start_vectors(mixing.vectors(table, {"en": 1.0}).where("n_tokens > 0"), mixing.TOPICS).to_pylist()
    for group in ("", "=en"):
        own = x[[g == group for g, *_ in told]]
        mean = own.mean(axis=0)
        assert np.allclose(model.means[group], mean, atol=1e-6)
        begun = np.zeros((sum(s["group"] == group for s in starts), mixing.DIMS))
        for row, s in zip(begun, (s for s in starts if s["group"] == group)):
            row[np.frombuffer(s["dims"], np.uint16)] = np.sqrt(np.frombuffer(s["counts"], np.uint32))
        centroids = lloyd(directions(own - mean), directions(directions(begun * idf) - mean))
        assert np.allclose(model.centroids[group], centroids, atol=1e-4)


def test_equal_texts_of_several_languages(spark):
    """Each language's clusters begin at `TOPICS` of its own vectors, also where languages share texts; its model is that of its documents alone."""
    rng = np.random.default_rng(8)
    shared = [" ".join(f"w{x}" for x in rng.integers(0, 60, 12)) for _ in range(40)]
    docs = [(k, t, lang, "src0") for k, (t, lang) in enumerate((t, lang) for lang, own in (("de", shared[::2]), ("en", shared), ("fr", shared[5:25])) for t in own)]
    docs += [(100 + k, " ".join(f"v{x}" for x in rng.integers(0, 60, 12)), ("de", "fr")[k % 2], "src0") for k in range(80)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    langs = {"de": 1.0, "en": 1.0, "fr": 1.0}
    told = mixing.vectors(table, langs)
    starts = mixing.start_vectors(told, mixing.TOPICS).column("group").to_pylist()
    assert {g: starts.count(g) for g in starts} == {"=de": 8, "=en": 8, "=fr": 8}
    model = mixing.fit_topics(told)
    sums = mixing.added_up(told.select("group", "dims", "counts"), model, mixing.TOPICS)
    assert {g: sum(n for (name, _), (n, _) in sums.items() if name == g) for g in model.groups} == {"=de": 60, "=en": 40, "=fr": 60}


def test_batches_of_clustering_are_small(spark, monkeypatch):
    """Frequencies and all rounds are planned with small batches, and the session has its own again."""
    table = mixing.cut(mixing.vectors(documents(spark), {"en": 1.0}))
    seen, plain = [], mixing.arrow_map
    monkeypatch.setattr(mixing, "arrow_map", lambda df, *more, **named: seen.append(spark.conf.get(BATCH_SETTING)) or plain(df, *more, **named))
    before = spark.conf.get(BATCH_SETTING)
    mixing.fit_topics(table, 2)
    assert len(seen) > 2 and set(seen) == {str(BATCH_ROWS) if before == DEFAULT_BATCH_ROWS else before} and spark.conf.get(BATCH_SETTING) == before


def test_vectors_of_a_slice():
    """Topics and lengths of a slice with a group that the model doesn't have are those of plain dot products; so are all sums."""
    rng, n = np.random.default_rng(3), 30
    dims = [np.sort(rng.choice(mixing.DIMS, k % 7, replace=False)).astype(np.uint16) for k in range(n)]
    counts = [rng.integers(1, 9, len(d)).astype(np.uint32) for d in dims]
    group = ["=en", "=xx", "=de"] * (n // 3)
    batch = mixing.pa.RecordBatch.from_pydict({"group": group, "dims": [d.tobytes() for d in dims], "counts": [c.tobytes() for c in counts]})
    idf = rng.uniform(1, 5, mixing.DIMS)
    means = {g: rng.uniform(0, 0.01, mixing.DIMS).astype(np.float32) for g in ("=de", "=en")}
    model = mixing.TopicModel(idf, means, {"=de": mixing.unit(rng.normal(size=(2, mixing.DIMS))), "=en": mixing.unit(rng.normal(size=(3, mixing.DIMS)))})
    rows = model.rows(batch.slice(4, 20))
    found, inverse = model.topics(rows)
    want = [k for k in range(4, 24) if group[k] != "=xx" and len(dims[k])]
    assert (rows.at + 4).tolist() == want
    total = np.zeros((2, mixing.DIMS))
    for k, topic, length in zip(want, found.tolist(), inverse.tolist(), strict=True):
        x = np.zeros(mixing.DIMS)
        x[dims[k]] = np.sqrt(counts[k])
        x = x * idf / np.linalg.norm(x * idf)
        rest = x - means[group[k]]
        assert topic == int(np.argmax(model.centroids[group[k]] @ rest)) and length == pytest.approx(1 / np.linalg.norm(rest))
        total[int(group[k] == "=en")] += x
    assert np.allclose(rows.sums(rows.group, np.ones(len(want)), 2) / mixing.UNIT, total, atol=1e-6)
