"""Every registered query against its SQL, on the smallest tables."""

import os

import pandas
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def value(v):
    """Whole numbers beside nulls come as doubles from one side and as whole numbers from the other."""
    if v is None or v is pandas.NA or v != v:
        return "null"
    return repr(round(float(v), 6)) if isinstance(v, float) else str(v)


def shown(frame):
    frame = frame[sorted(frame.columns)]
    # A column of whole numbers and nulls is one of doubles in pandas.
    frame = frame.astype({c: "float64" for c in frame.columns if frame[c].dtype.kind in "iu" and frame[c].isna().any()})
    return sorted(tuple(map(value, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


@pytest.mark.parametrize("name", ["dfs_hashed", "w2v_vectors", "w2v_cbow_vectors", "fasttext_vectors", "community_walks"])
def test_query_without_sql(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["entity", "walk"]
