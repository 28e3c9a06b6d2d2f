"""Queries of this subpackage that SQL can express, against DuckDB on the smallest tables."""

import os

import pytest

from kinquery.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    cols = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(c) for c in cols]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())
