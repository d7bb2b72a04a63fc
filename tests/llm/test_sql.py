"""The corpus queries that SQL can express, against DuckDB at the smallest scale."""

import duckdb
import pytest

from fathomix.llm import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = catalog.queries()[name](spark, DATA), con.sql(catalog.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    row = lambda names, r: repr([round(v, 6) if isinstance(v, float) else v for v in (r[names.index(c)] for c in order)])
    assert sorted(row(df.columns, tuple(r)) for r in df.collect()) == sorted(row(want.columns, r) for r in want.fetchall())
