"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from tessera.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    out = catalog.QUERIES[name](spark, sf)
    done = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in done.description]
    assert sorted(out.columns) == sorted(columns)
    assert sorted(map(tuple, out.select(columns).collect())) == sorted(done.fetchall())
