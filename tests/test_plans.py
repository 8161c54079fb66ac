"""Physical-plan properties of every registered query: no joins without keys, no Python."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


@pytest.fixture(scope="module")
def plans(spark, tctx):
    return {k: fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            for k, fn in E.queries().items()}


def test_no_cross_joins_and_no_python(plans):
    bad = [(k, t) for k, p in plans.items() for t in FORBIDDEN if t in p]
    assert bad == []


def test_reports_read_pruned_parquet(spark, tctx):
    df = E.queries()["m02_quantiles"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(sender, [assistant,human])]" in plan or "In(sender" in plan
    assert "ReadSchema: struct<sender:string,tokens_text:bigint>" in plan
