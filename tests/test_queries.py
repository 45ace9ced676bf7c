"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest
from oracle import TABLES_AT, compare, connect

D = f"{TABLES_AT}/sf0.001"
CORE = [n for n in entry.oracle_sql() if not n.startswith(("p6_", "p7_", "p8_"))]


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    assert compare(spark, con, D, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
