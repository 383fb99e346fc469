"""Extra columns of any name and type pass through the operators and stages that keep a document's columns."""

from pathlib import Path

import pytest
from cases import documents
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import decontam, jaccard, langid
from marketloom.llm.line_dedup import dedup_lines
from marketloom.llm.text import free_names

SF = "/root/testdata/sf0.001"
#: Every name that an operator or a stage gives to a column of its own.
HELPERS = [
    "__digests", "__drop_id", "__n_lines", "__n_dropped", "__kept_sha256", "__rejected", "__lang_pred", "__score", "__n_cut", "__keep", "__key", "__row", "__text", "__t", "__one", "one", "c0", "key",
    "digests", "row", "name", "n", "prefix", "size", "component", "component_id", "sampled", "group", "order", "__N_Lines_",
]


def test_struct_fields_of_any_name(spark):
    odd = F.struct(F.lit(1).alias("a-b"), F.array(F.struct(F.lit("x").alias("c d"), F.lit(None).cast("date").alias("`e`"))).alias("select"))
    docs = documents(spark).withColumn("extra", odd).withColumn("we`ird name", F.lit(7))
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    model = langid.train(docs, F.lit(True))
    for out in (dedup_lines(docs), langid.identify(docs, model), decontam.decontaminate(docs, items)):
        assert out.columns[: len(docs.columns)] == docs.columns
        assert out.schema["extra"].dataType == docs.schema["extra"].dataType
        rows = out.select(F.col("extra").getField("a-b").alias("n"), F.col("`we``ird name`").alias("w")).distinct().collect()
        assert [(r.n, r.w) for r in rows] == [(1, 7)]


def marked(docs):
    """Each helper's name is a column that holds its own name and the row's id."""
    return docs.withColumns({c: F.concat_ws(":", F.lit(c), F.col("doc_id").cast("string")) for c in HELPERS})


def unharmed(out):
    wrong = [F.count_if(~F.col(c).eqNullSafe(F.concat_ws(":", F.lit(c), F.col("doc_id").cast("string")))).alias(c) for c in HELPERS]
    return not any(out.agg(*wrong).first())


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_helper_names_pass_every_stage(spark, name, stage):
    docs = marked(documents(spark))
    out = stage(spark, docs, SF)
    if name != "source_mixing":
        assert out.columns == docs.columns
    assert out.count() and unharmed(out)


def test_operators_choose_free_names(spark):
    docs = marked(documents(spark))
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    lines = dedup_lines(docs)
    assert lines.columns[len(docs.columns) :] == ["___n_lines", "___n_dropped", "___kept_sha256"] and unharmed(lines)
    assert lines.agg(F.sum("___n_lines")).first()[0] == dedup_lines(documents(spark)).agg(F.sum("__n_lines")).first()[0]
    clean = decontam.decontaminate(docs, items)
    assert clean.columns[-1] == "___n_cut" and unharmed(clean)
    assert jaccard.jaccard_components(docs).count() == docs.count()
    assert free_names(spark.range(1).toDF("__A"), "__a", "__b") == ["___a", "__b"]


def test_differing_rows_of_one_id_and_text_stay(spark):
    docs = documents(spark, [(7, "the very same text of all", "en", f"src{k % 10}") for k in range(20)])
    assert sorted(r.source for r in corpus_pipeline.ngram_jaccard_join(spark, docs, SF).collect()) == [f"src{k}" for k in range(10)]
    maps = docs.withColumn("m", F.create_map(F.lit("k"), F.col("source")))
    out = corpus_pipeline.ngram_jaccard_join(spark, maps, SF)
    assert out.columns == maps.columns and sorted(r.m["k"] for r in out.collect()) == [f"src{k}" for k in range(10)]
