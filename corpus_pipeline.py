"""Corpus pipeline: language ID, line deduplication, n-gram Jaccard join, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents; n_chars follows the text. Null ids, null and empty texts, repeated rows and extra
columns of any names pass through, but for what a stage decides on; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.decontam import decontaminate
from marketloom.llm.jaccard import jaccard_components
from marketloom.llm.langid import held_out, identify, train
from marketloom.llm.line_dedup import dedup_lines
from marketloom.llm.mixing import document_key, mix_documents
from marketloom.llm.queries import MIX_FRACTION, MIX_TARGETS, table
from marketloom.llm.text import cut, discard, free_names, packed_rows, passing_tables, quoted, unpacked


def measured(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def once(docs: DataFrame) -> DataFrame:
    """Rows that are equal in all columns once. Maps, which can't be compared, count by their JSON."""
    maps = [f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()]
    if not maps:
        return docs.dropDuplicates()
    names = dict(zip(maps, free_names(docs, *("__json" for _ in maps)), strict=True))
    told = docs.withColumns({name: F.to_json(F.struct(quoted(c)), {"ignoreNullFields": "false"}) for c, name in names.items()})
    return told.dropDuplicates([c for c in told.columns if c not in maps]).drop(*names.values())


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or too far from every centroid go, null and empty texts among them; a missing lang is filled with the prediction.

    Rows are judged alone, so repeated rows and null ids need no care; of languages at equal cosines the first wins; a very long text is one vector.
    """
    found, _, rejected = free_names(docs, "__lang_pred", "__score", "__rejected")
    judged = identify(docs, train(docs, ~held_out(3, 1))).where(~F.col(rejected))
    lang = F.coalesce("lang", found)
    return judged.withColumn("lang", lang).select(*map(quoted, docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the one with the largest doc_id only.

    Repeated rows of a doc_id lose the same lines, rows with a null id none; a null text stays null, a very long text or line is handled whole.
    """
    return measured(dedup_lines(docs).select(*map(quoted, docs.columns)))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays. Rows of one doc_id stay or go together,
    those that are equal in all columns once; rows with a null doc_id stay, as do null and empty texts. Pairs exactly at the threshold are near duplicates; a very long text is compared whole."""
    keep = jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, docs["doc_id"].cast("long") == keep["doc_id"], "left_semi")
    return once(kept).unionByName(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside any occurrence of a benchmark window are cut out, until none is left; no document goes.

    Null texts stay null; repeated rows and null ids need no care; a very long text is searched whole.
    """
    clean = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return cut(measured(clean.select(*map(quoted, docs.columns))))  # written here, in batches that are small next to a shard's index


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn, with topic, n_tokens, weight and probability (which replace columns of these names).

    Rows of one doc_id are drawn together, rows without one by their text; null and empty texts have no tokens and are drawn by the fraction; a very long
    text is drawn or not as one.
    """
    found = ["topic", "n_tokens", "weight", "probability"]
    mixed = mix_documents(docs, MIX_TARGETS, MIX_FRACTION).where("sampled").groupBy("key")
    mixed = cut(mixed.agg(*(F.first(c).alias(c) for c in found)))
    kept = docs.drop(*(c for c in docs.columns if c.lower() in found))
    row, _ = packed_rows(kept, None)
    # The drawn rows' columns travel in a struct, so that none can clash with the key's or the results' names.
    return unpacked(docs.select(document_key().alias("key"), row).join(mixed, "key"), kept.columns, *map(F.col, found), leave=None)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: Centroids, set joins by trees and raking to convergence have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table. What a stage wrote is deleted when the next has written its documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with passing_tables() as keep:
            found = stage(spark, docs, sf_dir)
            docs = keep(found if hasattr(found, "cut_path") else cut(found))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
