"""Tables that only pass results on are gone at the end of their block; what is kept belongs to the block around."""

from pathlib import Path

import pyarrow as pa
from cases import documents
from pyspark.sql import functions as F

from marketloom.llm import decontam, langid
from marketloom.llm.text import BATCH_SETTING, arrow_map, cut, passing_tables


def there(df):
    return Path(df.cut_path.removeprefix("file://")).exists()


def test_kept_tables_go_with_the_block_around(spark):
    with passing_tables() as outer:
        with passing_tables() as inner:
            gone, passed, kept = (cut(spark.range(k)) for k in (1, 2, 3))
            inner(passed)
            inner(kept)
        assert not there(gone) and there(passed) and there(kept)
        outer(kept)
    assert not there(passed) and there(kept) and kept.count() == 3


def test_training_leaves_no_tables(spark, monkeypatch):
    written = []
    for module in (langid, decontam):
        monkeypatch.setattr(module, "cut", lambda df: written.append(cut(df)) or written[-1])
    langid.train(documents(spark), F.lit(True))
    decontam.phrase_blocks(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    assert len(written) == 3 and not any(map(there, written))


def test_the_session_stays_as_it_was(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    rows = spark.range(5000).coalesce(1)
    before = spark.conf.get(BATCH_SETTING)
    assert cut(arrow_map(rows, sizes, "n long")).agg(F.max("n")).first()[0] == 2000
    assert spark.conf.get(BATCH_SETTING) == before == "10000" and arrow_map(rows, sizes, "n long").first().n == 5000
    spark.conf.set(BATCH_SETTING, "700")
    try:
        assert cut(arrow_map(rows, sizes, "n long")).agg(F.max("n")).first()[0] == 700
    finally:
        spark.conf.set(BATCH_SETTING, before)
