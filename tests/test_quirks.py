"""Pinned behaviours (SURVEY Q-rows): what we keep from the source and what we fix on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.config import Config
from parley.functions import text as T
from parley.operators.ranking import flag_first
from parley.plans import REGISTRY, m12_errors
from tests.conftest import SF_SMALL, rows


def test_q5_path_mask_runs_before_url_mask(spark):
    df = spark.createDataFrame([("  see https://a.b/c  and 123e4567-e89b-12d3-a456-426614174000\tnow ",)], ["m"])
    got = df.select(m12_errors.normalize(F.col("m")).alias("n")).collect()[0]["n"]
    assert got == "see https:<PATH> and <UUID> now"


def test_q5_normalize_truncates_to_200(spark):
    df = spark.createDataFrame([("x" * 500,)], ["m"])
    assert len(df.select(m12_errors.normalize(F.col("m")).alias("n")).collect()[0]["n"]) == 200


def test_error_categories_first_match_wins(spark):
    df = spark.createDataFrame([("Permission denied: not found",), ("429 Too Many Requests",), ("weird",),
                                ("Malformed JSON",), ("error 4040",)], ["m"])
    got = [r["c"] for r in df.select(m12_errors.categorize(F.col("m")).alias("c")).collect()]
    assert got == ["NOT_FOUND", "RATE_LIMIT", "OTHER", "SYNTAX", "OTHER"]


def test_q8_nulls_sort_last_in_first_row(spark):
    df = spark.createDataFrame([("g", "a", None), ("g", "b", 5), ("g", "c", 7)], "g string, id string, t int")
    first = {r["id"]: r["is_first"] for r in flag_first(df, "g", ["t"], "id").collect()}
    last = {r["id"]: r["is_last"] for r in flag_first(df, "g", ["t"], "id", "is_last", last=True).collect()}
    assert first == {"a": False, "b": True, "c": False}
    assert last == {"a": False, "b": False, "c": True}


def test_q10_two_empty_text_blocks_make_one_token(spark):
    df = spark.createDataFrame([(["", ""],)], "parts array<string>")
    r = df.select(F.array_join("parts", "\n").alias("t")).select(
        F.length("t").alias("chars"), T.approx_tokens(F.col("t")).alias("tok")).collect()[0]
    assert (r["chars"], r["tok"]) == (1, 1)


def test_token_estimate(spark):
    df = spark.createDataFrame([("",), ("abc",), ("abcd" * 10,), (None,)], "s string")
    assert [r["t"] for r in df.select(T.approx_tokens(F.col("s")).alias("t")).collect()] == [0, 1, 10, 0]


def test_fence_regex_end_of_text(spark):
    df = spark.createDataFrame([("```py\nx\n",), ("a ```z``` b",), ("```\n\n```",)], "s string")
    got = [r["c"] for r in df.select(T.fence_bodies(F.col("s")).alias("c")).collect()]
    # \z keeps the final newline of an unterminated block; an opening without newline is no block
    assert got == [["x\n"], [], ["\n"]]


def test_q6_top_lists_by_id_or_merged_by_name(spark):
    from parley.plans.base import context_for_testdata

    by_id = context_for_testdata(spark, SF_SMALL, Config())
    merged = context_for_testdata(spark, SF_SMALL, Config(merge_by_name=True))
    a = REGISTRY["m13_top_edits"][1](by_id).collect()
    b = REGISTRY["m13_top_edits"][1](merged).collect()
    assert all(r["conversation_uuid"] is not None for r in a)
    assert all(r["conversation_uuid"] is None for r in b)


def test_q4_both_highest_rate_rules_offered(spark):
    from parley.plans.base import context_for_testdata

    ctx = context_for_testdata(spark, "/root/testdata/sf0.01", Config())
    kinds = {r["kind"] for r in REGISTRY["m12_highlight_tools"][1](ctx).collect()}
    assert kinds == {"most_errors", "highest_rate_by_count", "highest_rate"}


def test_q13_values_are_unrounded_beyond_6_decimals(spark):
    from parley.plans.base import context_for_testdata

    ctx = context_for_testdata(spark, SF_SMALL, Config())
    v = REGISTRY["m02_volume"][1](ctx).collect()[0]
    # kept as doubles at 6 decimals (no half-even / half-up display rounding in the data)
    assert v["share_human"] == round(v["share_human"], 6) and v["share_human"] != round(v["share_human"], 1)


def test_approx_quantiles_switch(spark):
    from parley.plans.base import context_for_testdata

    exact = context_for_testdata(spark, SF_SMALL, Config())
    approx = context_for_testdata(spark, SF_SMALL, Config(approx_quantiles=True))
    e = rows(REGISTRY["m01_quantiles"][1](exact), "metric", "n")
    a = rows(REGISTRY["m01_quantiles"][1](approx), "metric", "n")
    assert e == a


def test_approx_distinct_switch(spark):
    from parley.plans.base import context_for_testdata

    exact = context_for_testdata(spark, SF_SMALL, Config())
    approx = context_for_testdata(spark, SF_SMALL, Config(approx_distinct=True))
    e = REGISTRY["m11_totals"][1](exact).collect()[0]
    a = REGISTRY["m11_totals"][1](approx).collect()[0]
    assert e["citations"] == a["citations"]
    for c in ("messages", "conversations", "domains", "urls"):
        assert abs(a[c] - e[c]) <= max(1, 0.05 * e[c])


def test_q1_one_zone_for_local_time_columns(spark):
    from parley.plans.base import context_for_testdata

    utc = context_for_testdata(spark, SF_SMALL, Config(tz="UTC"))
    tokyo = context_for_testdata(spark, SF_SMALL, Config(tz="Asia/Tokyo"))  # UTC+9, no DST
    a = dict(rows(REGISTRY["m04_new_convo_hour"][1](utc), "hour", "n"))
    b = dict(rows(REGISTRY["m04_new_convo_hour"][1](tokyo), "hour", "n"))
    assert all(b[h] == a[(h - 9) % 24] for h in range(24))


def test_q2_thinking_months_use_the_session_zone(spark):
    from parley.plans.base import context_for_testdata

    a = REGISTRY["m03_monthly"][1](context_for_testdata(spark, SF_SMALL, Config(tz="UTC")))
    b = REGISTRY["m03_monthly"][1](context_for_testdata(spark, SF_SMALL, Config(tz="Pacific/Kiritimati")))
    assert rows(a) == rows(b)


def test_q7_ties_broken_by_position_then_uuid(spark):
    df = spark.createDataFrame([("g", "b", 1, 2), ("g", "a", 1, 2), ("g", "c", 1, 1)],
                               "g string, id string, t int, pos int")
    first = [r["id"] for r in flag_first(df, "g", ["t", "pos"], "id").where("is_first").collect()]
    assert first == ["c"]  # same time: lowest position wins
    first2 = [r["id"] for r in flag_first(df.where("id != 'c'"), "g", ["t", "pos"], "id").where("is_first").collect()]
    assert first2 == ["a"]  # same time and position: lowest uuid wins


def test_q9_code_share_message_counts_truncated_to_integers(spark):
    from parley.plans.base import context_for_testdata

    df = REGISTRY["m10_code_share"][1](context_for_testdata(spark, SF_SMALL, Config()))
    types = dict(df.dtypes)
    assert types["message_count_p50"] == "bigint" and types["message_count_p95"] == "bigint"
    assert types["pct"] == "double"


def test_q12_block_length_pct_counts_zero_length_blocks(spark):
    from parley.operators.stats import S, bucketize

    df = spark.createDataFrame([(0,), (50,), (150,), (0,)], "chars long")
    b = rows(bucketize(df, [S("chars", F.col("chars") > 0, total_cond=F.lit(True))],
                       [("<100", 0, 100), ("100+", 100, 10 ** 9)]), "bucket", "n", "pct")
    assert b == [("100+", 1, 25.0), ("<100", 1, 25.0)]  # denominator 4 blocks, not 2


def test_config_rejects_unknown_modes():
    import pytest

    with pytest.raises(ValueError):
        Config(quantile_mode="fast")
    with pytest.raises(ValueError):
        Config(window_chunk_rows=0)
