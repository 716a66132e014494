"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from sparkweft import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, Decimal)) else v


def test_all_have_sql():
    assert catalog.QUERIES.keys() == catalog.SQL.keys()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_against_sql(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = db.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["name", "cnt"]
    assert entry.queries().keys() >= catalog.QUERIES.keys()
