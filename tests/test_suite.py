"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os
from decimal import Decimal

import pytest

from kinquery.suite import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    cols = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    mine = sorted(str(tuple(shown(r[c]) for c in order)) for r in df.collect())
    theirs = sorted(str(tuple(shown(r[cols.index(c)]) for c in order)) for r in found.fetchall())
    assert mine == theirs


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
