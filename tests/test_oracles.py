"""Every query with a SQL counterpart gives the same rows, names and types."""

import glob
import os

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from check_oracles import duck_types, normal

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
MODEL_QUERIES = [n for n in QUERIES if n not in ORACLES]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    relation = con.sql(ORACLES[name])
    assert dict(df.dtypes) == duck_types(relation)
    got, want = normal(df.toPandas()), normal(relation.df())
    assert len(got) == len(want)
    for c in got.columns:
        same = (got[c].astype(object) == want[c].astype(object)) | (got[c].isna() & want[c].isna())
        assert same.all(), f"{c}: {(~same).sum()} values differ"


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
