"""Every catalogue query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__
from docskein.plans.catalog import CATALOG
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_sql(spark, duck, name):
    query, sql = CATALOG[name]
    got = query(spark, f"{DATA}/sf0.001")
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
    expected = sorted(map(repr, duck.sql(f"SELECT {columns} FROM ({sql})").fetchall()))
    rows = sorted(repr(tuple(r)) for r in got.select(*[f"`{c}`" for c in sorted(got.columns)]).collect())
    assert len(rows) == len(expected) > 0
    assert rows == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
