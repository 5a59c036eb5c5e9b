"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(str(plain(r[k])) for k in order) for r in values)), [columns[k] for k in order]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_duckdb(spark, duck, sf, name):
    got = entry.queries()[name](spark, sf)
    found = duck.execute(entry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in found.description], found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
