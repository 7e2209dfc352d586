"""The queries against their SQL, on a larger table than the other tests."""

import os

import duckdb
import pytest

from dialoom.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "sale_lines", "items"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = connection.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    df = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)
