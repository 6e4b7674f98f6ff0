import os

import duckdb
import pytest

from ensemblecast.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall())
