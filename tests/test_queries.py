"""Each query of the library proper against its SQL, over the smallest data."""

import pytest

from conftest import SF, same_rows
from mosaiq.plans import reference, training

QUERIES, ORACLES = reference.QUERIES | training.QUERIES, reference.ORACLES | training.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
