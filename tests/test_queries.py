"""Every query with SQL gives the rows of the SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from geoloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(columns, values):
    """Rows with their values in order of column names, as sorted text."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str(tuple(v[k] for k in order)) for v in values)


def collected(df):
    return rows(df.columns, df.collect())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf_dir, con, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = con.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert collected(got) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["raster_mean", "grid_sample", "feature_cap", "distance_sample"])
def test_independent_of_partitions(spark, sf_dir, name, monkeypatch):
    from geoloom.sources import bindings

    want = collected(registry.QUERIES[name](spark, sf_dir))
    real = bindings.table
    monkeypatch.setattr(bindings, "table", lambda *a: real(*a).repartition(7))
    assert collected(registry.QUERIES[name](spark, sf_dir)) == want
