"""Every query that has SQL gives the rows that DuckDB gives for it."""

import os

import duckdb
import pytest

from reelgrid.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    cells = frame[columns].map(lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v)
    return cells.astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_duckdb(spark, sf, duck, name):
    got, want = plain(registry.queries()[name](spark, sf).toPandas()), plain(duck.execute(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
