"""Every query with SQL against DuckDB on the same tables; the others run and are stable."""

import os

import duckdb
import pytest

from tessera.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet' )" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    out = catalog.QUERIES[name](spark, SF)
    got = rows(out.columns, [tuple(r) for r in out.collect()])
    if name not in catalog.ORACLES:
        assert got
        return
    con = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in con.description]
    assert sorted(out.columns) == sorted(columns)
    want = rows(columns, con.fetchall())
    assert len(got) == len(want)
    assert got == want
