"""Bounded-memory exact quantiles equal Spark's exact percentile."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.config import Config
from parley.operators.quantiles import brackets, exact_bounded, grouped_exact, narrowed, sketched
from parley.plans import REGISTRY
from tests.conftest import SF_SMALL, rows

QS = (0.5, 0.9, 0.95, 0.99)


@pytest.mark.parametrize("n,accuracy", [(1, 10), (4, 10), (150, 10), (3000, 10), (20000, 100)])
def test_matches_percentile_with_hot_value(spark, n, accuracy):
    rng = np.random.default_rng(n)
    vals = rng.exponential(100, n).round(3)
    vals[: n // 3] = 7.0  # one value holds a third of the rows
    df = spark.createDataFrame([(float(v),) for v in vals], "a double")
    sub = F.when(F.col("a") > 50, F.col("a") * 2)
    got = {(r.sid, r.qi): r.value for r in exact_bounded(df, [F.col("a"), sub], QS, accuracy).collect()}
    ref = df.agg(F.percentile("a", list(QS)).alias("p"), F.percentile(sub, list(QS)).alias("s")).collect()[0]
    for j in range(len(QS)):
        assert got[(0, j)] == pytest.approx(ref.p[j], abs=1e-9)
        if ref.s is None:
            assert (1, j) not in got
        else:
            assert got[(1, j)] == pytest.approx(ref.s[j], abs=1e-9)


@pytest.mark.parametrize("levels", [1, 4])
def test_narrowed_brackets_match_percentile(spark, levels):
    """Many distinct values, coarse first sketch, brackets far above the limit, a heavy value, a group that is not open."""
    df = spark.range(300_000, numPartitions=8).select(
        F.when(F.col("id") % 1000 == 0, "few").when(F.col("id") % 3 == 0, "heavy").otherwise("many").alias("g"),
        F.when((F.col("id") % 3 == 0) & (F.col("id") % 2 == 0), F.lit(1e8))
        .otherwise(F.exp(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 50_000.0)).alias("x"))
    got = {(r.g, r.qi): r.value for r in grouped_exact(df, ["g"], "x", QS, 10, True, limit=5000, levels=levels).collect()}
    for r in df.groupBy("g").agg(F.percentile("x", list(QS)).alias("p")).collect():
        for j in range(len(QS)):
            assert got[(r.g, j)] == pytest.approx(r.p[j], rel=1e-12)


def test_narrowing_bounds_the_bracket(spark):
    """Accuracy 10 and 10^6 distinct values: the first brackets hold most rows, the narrowed ones at most the limit."""
    df = spark.range(1_000_000, numPartitions=8).select(F.lit(0).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("x"))
    br = brackets(sketched(df, ["g"], "x", QS, 10), ["g"], list(QS), 10, [0, 1, 2, 3])

    def rows_inside(b):
        return max(df.join(F.broadcast(b), "g").agg(*[F.count_if(F.col("x").between(F.col(f"_L{i}"), F.col(f"_H{i}")))
                                                      for i in range(len(QS))]).collect()[0])

    assert rows_inside(br) > 300_000
    for _ in range(3):
        br = narrowed(df, br, ["g"], "x", list(QS), limit=5000)
    assert rows_inside(br) <= 5000


@pytest.mark.parametrize("key", ["m01_quantiles", "m02_quantiles", "m05_per_convo", "m06_gaps", "m06_lifetime",
                                 "m05_duration", "m12_compare", "m13_multi_root", "m13_len_delta", "m03_resp_by_bucket",
                                 "m10_code_share", "m08_doc_len", "m10_block_len"])
def test_modes_agree(spark, key):
    from parley.plans.base import context_for_testdata

    exact = context_for_testdata(spark, SF_SMALL, Config(quantile_mode="exact"))
    bounded = context_for_testdata(spark, SF_SMALL, Config(bounded_accuracy=10))
    assert rows(REGISTRY[key][1](bounded)) == rows(REGISTRY[key][1](exact))


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                       min_size=1, max_size=300),
       accuracy=st.sampled_from([1, 2, 5, 1000]))
def test_bounded_quantiles_property(spark, values, accuracy):
    df = spark.createDataFrame([(v,) for v in values], "a double")
    got = {r.qi: r.value for r in exact_bounded(df, [F.col("a")], QS, accuracy).collect()}
    for j, q in enumerate(QS):
        ref = float(np.quantile(np.array(values), q))
        assert got[j] == pytest.approx(ref, rel=1e-9, abs=1e-6)
