import base64
import zlib

import numpy as np
from cases import documents, texts
from pyspark.sql import functions as F

from marketloom.llm import langid

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, ~langid.held_out(3, 1))
    found = langid.identify(docs, model).where(langid.held_out(3, 1) & F.col("lang").isNotNull() & (F.length("text") > 100))
    right = found.agg(F.avg((F.col("lang") == F.col("__lang_pred")).cast("double")), F.avg(F.col("__rejected").cast("double"))).first()
    assert right[0] > 0.97 and right[1] < 0.01
    assert len(model.langs) == len(model.centroids) > len(set(model.langs))
    again = langid.train(docs, ~langid.held_out(3, 1))
    assert (again.centroids == model.centroids).all()


def test_odd_rows(spark):
    docs = documents(spark)
    found = langid.identify(docs, langid.train(docs, F.lit(True)))
    assert found.columns == [*docs.columns, "__lang_pred", "__score", "__rejected"] and found.count() == len(texts())
    rows = {r.doc_id: r for r in found.collect()}
    for i in (300, 301, 302, 305):
        assert (rows[i]["__lang_pred"], rows[i]["__score"], rows[i]["__rejected"]) == ("und", 0.0, True)
    assert rows[303]["__lang_pred"] in ("en", "de") and 0 <= rows[303]["__score"] <= 1
    empty = langid.train(docs.limit(0), F.lit(True))
    assert langid.identify(docs, empty).where("__lang_pred <> 'und'").count() == 0
    assert langid.identify(docs.limit(0), empty).count() == 0


def test_rejects_what_is_no_known_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, ~langid.held_out(3, 1))
    rng = np.random.default_rng(3)
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. "
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. "
    junk = [polish * 10, finnish * 10]
    for n in (500, 1000, 5000, 20_000):
        junk += [bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode(), base64.b64encode(rng.bytes(n * 3 // 4)).decode(), "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n // 3)))]
    junk += [rng.bytes(n // 2).hex() for n in (1000, 5000, 20_000)]
    names, _, rejected = model.predict(np.stack([langid.ngram_counts(t.encode()) for t in junk]))
    assert rejected.all(), [(t[:20], len(t)) for t, r in zip(junk, rejected) if not r]
    short = [r.text for r in docs.where(langid.held_out(3, 1) & F.col("lang").isNotNull() & F.length("text").between(5, 60)).collect()] + ["Hello world"]
    counts = [c for c in (langid.ngram_counts(t.encode()) for t in short) if c is not None]
    assert len(counts) > 20 and model.predict(np.stack(counts))[2].mean() < 0.02 and not model.predict(counts[-1][None])[2][0]


def plain_vector(text: str | None) -> np.ndarray | None:
    """Trigram counts one by one; None without a letter."""
    data = (text or "").encode()
    folded = [32]
    for b in data:
        c = b + 32 if 65 <= b <= 90 else b
        kept = 97 <= c <= 122 or c >= 128
        if kept or folded[-1] != 32:
            folded.append(c if kept else 32)
    folded.append(32)
    if not any(x.isalpha() for x in data.decode()):
        return None
    counts = np.zeros(langid.DIMS)
    for a, b, c in zip(folded, folded[1:], folded[2:]):
        counts[((a << 16 | b << 8 | c) * 0x9E3779B97F4A7C15 % 2**64) >> 52] += 1
    return counts


def test_query_against_plain_judgement(spark):
    from marketloom.llm.queries import queries

    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs, ~langid.held_out(3, 1))
    text = {r.doc_id: r.text for r in docs.collect()}
    found = queries()["op9_language_id"](spark, small).collect()
    assert len(found) == len(text)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        counts = plain_vector(text[r.doc_id])
        if counts is None:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        x = np.sqrt(counts) * model.idf
        cosines = [sum(x * c) / np.linalg.norm(x) for c in model.centroids.astype(float)]
        best = int(np.argmax(cosines))
        assert abs(r.score - cosines[best]) < 1e-5 and cosines[model.langs.index(r.lang_pred)] > -1
        assert max(c for c, lang in zip(cosines, model.langs) if lang == r.lang_pred) > cosines[best] - 1e-5
        n, least = counts.sum(), [0.0, *model.least[best]]
        step = min(max(np.log2(max(1, n) / 16) + 1, 0), len(langid.LENGTHS))
        low = min(int(step), len(langid.LENGTHS) - 1)
        bound = least[low] + (step - low) * (least[low + 1] - least[low])
        if abs(cosines[best] - bound) > 1e-5:
            assert r.rejected == (cosines[best] < bound)


def test_blocks_of_languages_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs, F.lit(True), per_lang=40)
    sample = [(r.text or "").encode() for r in docs.collect()]
    whole = langid.judge_texts(sample, [lambda: model])
    parts = langid.judge_texts(sample, [lambda m=m: m for m in langid.blocks_of(model, 1)])
    assert len(langid.blocks_of(model, 1)) == 4 and whole[0] == parts[0] and (whole[2] == parts[2]).all() and np.allclose(whole[1], parts[1], atol=1e-6)
    assert len(langid.blocks_of(langid.train(docs.limit(0), F.lit(True)))) == 1


def test_pieces_come_from_the_whole_text():
    for size in (0, 15, 16, 31, 33, 5000, 20_000):
        ids = np.arange(size)
        pieces = langid.pieces_of(size, langid.cut_pieces(ids))
        assert [(i, p[0], p[-1]) for i, p in pieces] == [(i, a, z - 1) for i, a, z in langid.piece_places(size)]
        assert all(len(p) == langid.LENGTHS[i] for i, p in pieces)
    assert max(p[-1] for _, p in pieces) == 20_000 // 16 * 16 - 1


def test_learns_from_all_rows(spark):
    """Frequencies are those of all 1,500 texts of a language, and centroids, all together, the sums of their own texts; bounds come from counts of all pieces."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"{'abcde'[k % 5]}{chr(97 + x)}{chr(97 + y)}" for x, y in rng.integers(0, 26, (30, 2))), ("en", "de")[k % 2]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, F.lit(True))
    counts = np.stack([langid.ngram_counts(t.encode()) for _, t, _ in rows])
    assert np.allclose(model.idf, np.log(3001 / (1 + (counts > 0).sum(axis=0))) + 1, atol=1e-5)
    x = langid.weighted(counts, model.idf)
    for lang in ("en", "de"):
        own, centroids = x[[name == lang for _, _, name in rows]], model.centroids[[name == lang for name in model.langs]]
        nearest = (own @ centroids.T).argmax(axis=1)
        again = np.stack([own[nearest == k].sum(axis=0) for k in range(len(centroids))])
        again /= np.linalg.norm(again, axis=1, keepdims=True)
        assert ((again * centroids).sum(axis=1) > 0.99).all()
    held = np.bincount(rng.integers(300, 900, 5000), minlength=langid.BINS)
    assert abs(langid.low_quantile(held) - np.quantile(np.repeat(np.arange(langid.BINS), held), langid.REJECT_QUANTILE) / langid.BINS) < 1e-12
