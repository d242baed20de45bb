"""Queries of the subpackage that SQL can express."""

import duckdb
import pytest

from hearthlog.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([dict(zip(names, r))[c] for c in columns]) for r in found.fetchall())
