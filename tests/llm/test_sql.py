"""Queries of this list that SQL can express, against DuckDB."""

import duckdb
import pytest

from panelspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    got = [tuple(round(r[c], 4) if isinstance(r[c], float) else r[c] for c in cols) for r in queries.QUERIES[name](spark, SF).collect()]
    assert sorted(got, key=str) == sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in want.fetchall()), key=str)
