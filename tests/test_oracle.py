"""Every registered query equals its SQL on the test tables."""

from __future__ import annotations

import pytest

import oracle
from vitalframe.catalog import registry

REGISTRY = registry()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_query_equals_sql(spark, con, sf, name):
    fn, sql = REGISTRY[name]
    equal, message = oracle.compare(spark, con, sf, fn, sql)
    assert equal, message


# ``model_answers`` collects the whole audit
@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if not sql and n != "model_audit"])
def test_query_runs(spark, sf, name):
    assert REGISTRY[name][0](spark, sf).collect()
