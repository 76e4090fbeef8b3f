"""Every query of the reference's operators against its SQL, over the size that the driver compares."""

import pytest
from compare import duck_rows, spark_rows

import __spark_entry__ as entry
from foliant.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(ORACLES[name], SF)


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
