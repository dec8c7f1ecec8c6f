"""Every query runs on the smallest tables and equals its SQL there."""

from __future__ import annotations

import pytest

import __spark_entry__
from brindle import plans
from tests.compare import assert_same
from tests.conftest import DATA

ORACLES = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, f"{DATA}/sf0.001").toPandas()
    if name in ORACLES:
        assert_same(got, duck.execute(ORACLES[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["cell_id", "total", "llik"]
    assert df.count() > 0


def test_oracles_are_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
