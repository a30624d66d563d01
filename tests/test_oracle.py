"""Every registered query against its SQL form, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(entry._QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(entry._QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, name) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 6
