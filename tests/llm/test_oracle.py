"""Queries of the corpus operators against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from marketloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def test_names():
    assert {name.split("_")[0] for name in queries()} == {f"op{n}" for n in range(1, 14)}
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    relation = con.sql(oracle_sql()[name])
    df = queries()[name](spark, SF)
    assert set(df.columns) == set(relation.columns)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, relation.select(*df.columns).fetchall()))
