"""Every registered query of the library against DuckDB on the smallest tables."""

import datetime as dt
import decimal
from pathlib import Path

import duckdb
import pytest

from marketloom.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "supplier", "orders", "lineitem"]

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)[:10]
    if isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool):
        return repr(float(value))
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = table(df.columns, df.collect())
    assert found[1] or name == "coverage_filter"  # the smallest tables have no ticker of such coverage
    if name in ORACLE:
        relation = duck.sql(ORACLE[name])
        assert found == table(relation.columns, relation.fetchall())
