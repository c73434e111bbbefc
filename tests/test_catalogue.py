"""Every registered query of the retrieval engine against its SQL on DuckDB."""

import duckdb
import pytest

from skerry.operators import facets
from skerry.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    ours = sorted(repr([plain(r[c]) for c in order]) for r in got.collect())
    theirs = sorted(repr([plain(v) for _, v in sorted(zip(want.columns, row, strict=True))]) for row in want.fetchall())
    assert ours == theirs


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_summary():
    text = "Rivers carry stones. Cats sleep. Rivers carry stones and stones carry rivers. Nothing else."
    assert facets.summarise(text, sentences=1) in text
    assert "Cats" in facets.summarise(text, query="cats", sentences=1)
    assert facets.summarise("") == "" and len(facets.summarise("w " * 500).split()) <= 150
