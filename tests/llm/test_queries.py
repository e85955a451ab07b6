"""The registered queries of the corpus operators against their SQL."""

import os

import pytest

from sparkloom.llm import oracle, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in got.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(got.fetchall(), key=repr)
