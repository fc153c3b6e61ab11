"""Every registered query against its SQL, over the small tables."""

import math

import duckdb
import pytest

from contrail.plans import oracle
from contrail.plans import queries as plans

from ..conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events".split()


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.sql()))
def test_against_sql(spark, duck, name):
    df, expected = plans.REGISTERED[name](spark, DATA), duck.sql(oracle.sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    found = [tuple(shown(r[c]) for c in expected.columns) for r in df.collect()]
    assert sorted(found) == sorted(tuple(map(shown, r)) for r in expected.fetchall())


def test_all_sql_is_registered():
    assert set(oracle.sql()) <= set(plans.REGISTERED)
