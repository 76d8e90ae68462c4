"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__
import registry
from registry.check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
