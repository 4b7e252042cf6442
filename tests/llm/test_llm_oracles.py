"""Queries that SQL can express against DuckDB."""

import duckdb
import pytest

from prosemill.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_rows_are_those_of_the_oracle(spark, sf, name):
    con = duckdb.connect()
    for name_ in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{sf}/{name_}.parquet'")
    rel = con.sql(oracles.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(map(tuple, got.select(*rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
