"""Invariants of the report shapes on the driver tables (sf0.001)."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators.stats import S, bucketize, summary_stats
from parley.plans import REGISTRY, m01_length
from tests.conftest import one, rows


def run(ctx, key):
    return REGISTRY[key][1](ctx)


def test_bucket_counts_sum_to_population_minus_out_of_range(tctx):
    b = run(tctx, "m01_buckets").where(F.col("metric") == "message_count")
    total = sum(r["n"] for r in b.collect())
    mc = [r["message_count"] for r in tctx.stats.conversation.collect() if r["message_count"] > 0]
    inside = sum(1 for v in mc if any(lo <= v < hi for _, lo, hi in m01_length.MSG_BUCKETS))
    assert total == inside and len(b.collect()) == len(m01_length.MSG_BUCKETS)


def test_summary_stats_match_numpy(tctx):
    vals = np.array([r["tokens_text"] for r in tctx.stats.message.collect() if r["tokens_text"] > 0], dtype=float)
    s = one(summary_stats(tctx.stats.message, [S("tokens_text", F.col("tokens_text") > 0)], tctx.cfg))
    for q in (50, 90, 95, 99):
        assert abs(s[f"p{q}"] - np.quantile(vals, q / 100)) < 1e-6
    assert s["n"] == len(vals) and abs(s["mean"] - vals.mean()) < 1e-6


def test_heatmaps_are_dense(tctx):
    assert run(tctx, "m04_heatmap").count() == 7 * 24
    assert run(tctx, "m04_new_convo_heatmap").count() == 7 * 24
    assert run(tctx, "m06_crosstab").count() == 7 * 4
    assert sum(r["n"] for r in run(tctx, "m04_heatmap").collect()) == tctx.stats.message.count()


def test_per_conversation_sums_equal_totals(tctx):
    conv = tctx.stats.conversation.agg(F.sum("tokens_human").alias("h"), F.sum("tokens_assistant").alias("a"),
                                       F.sum("message_count").alias("m")).collect()[0]
    vol = one(run(tctx, "m02_volume"))
    assert (vol["tokens_human"], vol["tokens_assistant"]) == (conv["h"], conv["a"])
    assert conv["m"] == tctx.stats.message.count()


def test_volume_shares_sum_to_100(tctx):
    v = one(run(tctx, "m02_volume"))
    assert abs(v["share_human"] + v["share_assistant"] - 100.0) < 1e-5


def test_children_equal_non_root_messages(tctx):
    children = sum(r["child_count"] for r in run(tctx, "child_count").collect())
    non_root = tctx.stats.message.where(~F.col("is_root")).count()
    assert children == non_root


def test_bucketize_empty_series_keeps_zero_buckets(spark):
    df = spark.range(5).select(F.col("id").cast("double").alias("v"))
    b = rows(bucketize(df, [S("v", F.col("v") > 100)], [("a", 0, 1), ("b", 1, 2)]), "bucket", "n", "pct")
    assert b == [("a", 0, 0.0), ("b", 0, 0.0)]


def test_closed_buckets(spark):
    df = spark.range(1, 8).select(F.col("id").alias("v"))
    b = rows(bucketize(df, [S("v")], [("1", 1, 1), ("2-5", 2, 5), ("6+", 6, 99)], closed=True), "bucket", "n")
    assert b == [("1", 1), ("2-5", 4), ("6+", 2)]


def test_post_error_counts_cover_every_error_message(tctx):
    n = sum(r["n"] for r in run(tctx, "m12_post_error").collect())
    from pyspark.sql import functions as G

    errs = (tctx.tables.tool_results.where("is_error").select("message_uuid").distinct()
            .join(tctx.stats.message.select("message_uuid"), "message_uuid").count())
    assert n == errs and G is not None


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-100, 100, allow_nan=False), max_size=200),
       cuts=st.lists(st.integers(-120, 120), min_size=2, max_size=6, unique=True),
       closed=st.booleans())
def test_bucketize_property(spark, values, cuts, closed):
    cuts = sorted(cuts)
    edges = [(f"b{i}", float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["bucket"]: (r["n"], r["pct"]) for r in bucketize(df, [S("v")], edges, closed=closed).collect()}
    for label, lo, hi in edges:
        n = sum(1 for v in values if lo <= v and (v <= hi if closed else v < hi))
        pct = 0.0 if not values else round(100.0 * n / len(values), 6)
        assert got[label] == (n, pytest.approx(pct, abs=1e-6))
