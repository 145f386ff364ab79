"""Every query against its SQL, and those without SQL for rows and a stable schema."""

from __future__ import annotations

import pytest

from palimpsest import registry

from . import compare
from .conftest import SF

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert compare.differences(QUERIES[name](spark, SF), SQL[name], SF) == ""
    assert compare.oracle(SQL[name], SF)[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.limit(1).count() == 1
