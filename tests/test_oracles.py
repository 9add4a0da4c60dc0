"""Every query with SQL, on whole tables, against DuckDB."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["series_id", "week_end", "t", "y"]
    assert df.where("y IS NULL").count() == 0 and df.select("series_id").distinct().count() == 25
