"""The pipeline's stages on awkward documents and against brute force on the smallest tables."""

from pathlib import Path

import numpy as np
import pytest
from cases import alnum_words, ascii_lower, components, decontaminate, documents, line_dedup, shingles, texts

import corpus_pipeline
from marketloom.llm.langid import held_out, identify, train

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {str(r.item_id): r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = rows_of(out)
        if name == "language_id":
            kept = identify(docs, train(docs, ~held_out(3, 1))).where("not __rejected")
            assert after == rows_of(kept) and len(after) >= 0.97 * len(before)
        elif name == "line_dedup":
            assert after == {i: kept for (i, _), (_, _, kept) in zip(before.items(), line_dedup(list(before.items())))}
        elif name == "ngram_jaccard_join":
            roots = components({i: [shingles(t)] for i, t in before.items()})
            assert after == {i: t for i, t in before.items() if roots[i][0] == i or not shingles(t)}
        elif name == "benchmark_decontamination":
            assert after.keys() == before.keys()
            for i, text in before.items():
                w, hit, _ = decontaminate(text, items)
                assert alnum_words(after[i]) == [x for p, x in enumerate(w) if p not in hit] if hit else after[i] == text
        else:
            assert after.items() <= before.items() and 0.3 * len(before) < len(after) < 0.8 * len(before)
            assert {"weight", "probability", "topic", "n_tokens"} <= set(out.columns)
        if name != "source_mixing":
            assert out.columns == docs.columns and all(r.n_chars == len(r.text or "") for r in out.collect())
        docs = out


def test_awkward_documents_pass_every_stage(spark, tmp_path):
    for n, rows in enumerate((texts(), [])):
        docs = documents(spark, rows)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if name != "source_mixing":
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{n}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}{k}"))
            assert docs.count() <= len(rows)
            assert name == "source_mixing" or not rows or {ascii_lower(r.text or "") for r in docs.where("doc_id = 100").collect()}
        assert rows or docs.count() == 0


def test_run_is_the_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and len(corpus_pipeline.STAGES) == 5


def test_mixing_learns_from_all_documents(spark, monkeypatch):
    """The model of the last stage has the document frequencies of all 1,200 documents of a language."""
    from marketloom.llm import mixing

    models, placed = [], mixing.TopicModel
    monkeypatch.setattr(mixing, "CLUSTER_ROUNDS", 1)
    monkeypatch.setattr(mixing, "TopicModel", lambda *a: models.append(placed(*a)) or models[-1])
    docs = spark.createDataFrame([(k, f"word{k % 7} other{k % 11} every", "en", "src0") for k in range(1200)], "doc_id long, text string, lang string, source string")
    corpus_pipeline.source_mixing(spark, docs, SF)
    assert abs(models[-1].idf - 1).min() < 1e-9  # `every` is in all
    assert models[-1].idf.max() == pytest.approx(1 + np.log(1201))
