"""Registered queries against their SQL, and the pipeline's contract."""

import duckdb
import pytest

from gatelight.catalog.check import ALL_TABLES, table_of
from gatelight.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.SQL[name])
    assert table_of(df.columns, map(tuple, df.collect())) == table_of(rel.columns, rel.fetchall())
    strict = con.sql(queries.SQL[name]).fetchall()
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(strict)


def test_entry_lists_the_operators():
    import __spark_entry__ as contract

    names = list(contract.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names
