"""Every registered query that has SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from attestra.plans import queries as q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    plain = lambda x: plain(x.item()) if hasattr(x, "item") else round(x, 5) if isinstance(x, float) else x
    return sorted((tuple(plain(x) for x in r) for r in df.values.tolist()), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_same_as_sql(spark, db, name):
    assert rows(q.QUERIES[name](spark, DIR).toPandas()) == rows(db.sql(q.ORACLE[name]).df())
