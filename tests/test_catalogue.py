"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import pytest

from tests.compare import duck_rows, spark_rows
from tributary.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    got = spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert got == duck_rows(ORACLES[name], sf_dir)
    else:
        assert got[1]


def test_no_cartesian_in_flagship(spark, sf_dir):
    plan = QUERIES["flagship_revenue_per_nation"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)" in plan
