"""The native operators against their SQL on DuckDB."""

import duckdb
import pytest

from skerry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(repr([r[c] for c in order]) for r in got.collect()) == sorted(repr([v for _, v in sorted(zip(want.columns, row, strict=True))]) for row in want.fetchall())
