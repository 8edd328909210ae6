"""The engine's queries against their SQL, run by another engine over the same tables."""

import math
import os

import duckdb
import pytest

from sievewell.plans.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHOSEN = sorted(ORACLES)


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(SF_DIR):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF_DIR}/{name}')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(str(_plain(tuple(r))) for r in got.select(*columns).collect())
    assert rows == sorted(str(_plain(r)) for r in want.fetchall())


#: Queries over element trees, which SQL cannot express; tests/test_pages.py holds them against fixtures.
WITHOUT_SQL = {"page_as_posting", "page_context"}


def test_every_query_has_sql():
    assert QUERIES.keys() - ORACLES.keys() == WITHOUT_SQL


def test_pages_give_a_row_each(spark, duck):
    (n,) = duck.execute("select count(*) from pages").fetchone()
    assert all(QUERIES[q](spark, SF_DIR).count() == n for q in WITHOUT_SQL)


def test_entry_points():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
