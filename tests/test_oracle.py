"""Every query of the catalogue against its SQL."""

import math
import os

import duckdb
import pytest

from siftmill import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return repr(v)
    return "nan" if math.isnan(float(v)) else f"{float(v):.6g}"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
    left = sorted(tuple(map(plain, r)) for r in got.select(*sorted(got.columns)).collect())
    right = sorted(tuple(map(plain, r)) for r in want.project(columns).fetchall())
    assert len(left) == len(right) and left == right
