"""Every named query against its ANSI SQL statement, on whole tables."""

import pytest
from check import compare, duck

from conftest import SF_DIR
from dotloom.plans import catalog


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries))
def test_query(spark, con, name):
    line = compare(spark, con, name, SF_DIR)
    assert not line.startswith("FAIL"), line
    assert " rows=0 " not in line or name == "profile_violations", line


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 110
