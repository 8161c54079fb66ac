"""Every registered query against its DuckDB oracle on the smallest driver tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from parley.oracle.compare import compare, connect
from parley.plans import REGISTRY
from tests.conftest import SF_SMALL

# the reports; queries of other subpackages have tests of their own
QUERIES = {k: f for k, f in E.queries().items() if k in REGISTRY}
ORACLE = {k: s for k, s in E.oracle_sql().items() if k in REGISTRY}


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, tctx, con, key):
    ok, msg = compare(QUERIES[key](spark, SF_SMALL), con, ORACLE[key], strict=True)  # floats bit for bit
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"bucket", "n", "pct"} <= set(df.columns)
