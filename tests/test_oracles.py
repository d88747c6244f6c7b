"""Every registered query of the engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from docloom.plans import oracles, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"create view {name} as from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(table):
    columns = sorted(table.schema.names)
    rounded = [[round(v, 6) if isinstance(v, float) else v for v in table[c].to_pylist()] for c in columns]
    return columns, sorted(map(repr, zip(*rounded, strict=True)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, DATA).toArrow()
    want = duck.sql(oracles.oracle_sql()[name]).to_arrow_table()
    assert rows(got) == rows(want)
