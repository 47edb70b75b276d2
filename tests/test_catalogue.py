"""Every registered stream query against its DuckDB equivalent."""

import duckdb
import pytest

from rillflow.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    other = db.sql(ORACLES[name])
    assert sorted(other.columns) == columns
    assert mine == sorted(other.select(*[f'"{c}"' for c in columns]).fetchall(), key=str)
