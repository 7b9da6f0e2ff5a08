"""Every query that SQL can express, beside that SQL in DuckDB, as multisets of rows."""

from collections import Counter

import duckdb
import pytest

from pairmill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = con.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    mine = Counter(tuple(r) for r in df.select(*cols).collect())
    assert mine == Counter(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0
