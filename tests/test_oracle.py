"""Every registered query with oracle SQL matches DuckDB on the sf0.001 tables."""

import pytest

from barwise.plans import load_all
from conftest import SF_SMALL
from oracle_check import compare

REG = load_all()
SQL_QUERIES = sorted(n for n, (_f, sql) in REG.items() if sql)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_matches_duckdb(spark, duck_small, name):
    fn, sql = REG[name]
    res = compare(fn(spark, SF_SMALL), sql, duck_small)
    assert res["ok"], res["problems"]
