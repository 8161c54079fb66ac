"""Hot-group protection: the chunked lag / rank / next-row operators equal the plain windows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.config import Config
from parley.operators.ordered import add_chunk, lag_within, min_after, row_number_within
from parley.plans import REGISTRY
from tests.conftest import SF_SMALL, rows

ORDER = ["created_at", "position", "message_uuid"]


@pytest.fixture(scope="module")
def msgs(tctx):
    return tctx.stats.message.select("conversation_uuid", "message_uuid", "position", "sender", "created_at")


def test_small_target_really_chunks(msgs):
    c, hot = add_chunk(msgs, "conversation_uuid", ORDER, 2)
    assert hot and c.where(F.col("_chunk") > 0).count() > 0


@pytest.mark.parametrize("target", [1, 2, 3, 10 ** 9])
def test_lag_matches_plain_window(msgs, target):
    w = Window.partitionBy("conversation_uuid").orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])
    plain = msgs.select("message_uuid", F.lag("created_at").over(w).alias("p"), F.lag("sender").over(w).alias("s"))
    got = lag_within(msgs, "conversation_uuid", ORDER, ["created_at", "sender"], target).select(
        "message_uuid", F.col("prev_created_at").alias("p"), F.col("prev_sender").alias("s"))
    assert rows(got) == rows(plain)


@pytest.mark.parametrize("target", [1, 3, 10 ** 9])
def test_row_number_matches_plain_window(msgs, target):
    w = Window.partitionBy("conversation_uuid").orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])
    plain = msgs.select("message_uuid", F.row_number().over(w).cast("long").alias("rn"))
    got = row_number_within(msgs, "conversation_uuid", ORDER, "rn", target).select("message_uuid", "rn")
    assert rows(got) == rows(plain)


@pytest.mark.parametrize("target", [1, 3, 10 ** 9])
def test_min_after_matches_plain_window(msgs, target):
    vals = {"nh": F.when(F.col("sender") == "human", F.col("position"))}
    w = (Window.partitionBy("conversation_uuid").orderBy("position", "message_uuid")
         .rowsBetween(1, Window.unboundedFollowing))
    plain = msgs.select("message_uuid", F.min(vals["nh"]).over(w).alias("nh"))
    got = min_after(msgs, "conversation_uuid", ["position", "message_uuid"], vals, target).select("message_uuid", "nh")
    assert rows(got) == rows(plain)


@pytest.mark.parametrize("key", ["m06_gaps", "m06_first_response", "m06_multi_session", "m03_assistant_rows",
                                 "m12_post_error"])
def test_reports_equal_with_forced_chunking(spark, key):
    from parley.plans.base import context_for_testdata

    plain = context_for_testdata(spark, SF_SMALL, Config())
    chunked = context_for_testdata(spark, SF_SMALL, Config(window_chunk_rows=2))
    assert rows(REGISTRY[key][1](chunked)) == rows(REGISTRY[key][1](plain))


@pytest.mark.parametrize("target", [1, 2, 5, 10 ** 9])
def test_top_k_per_group_salted_equals_plain(msgs, target):
    from parley.operators.ranking import top_k_per_group

    order = [F.col("position").desc(), F.col("message_uuid").asc()]
    got = top_k_per_group(msgs, ["conversation_uuid"], 2, order, "rank", target).select("message_uuid", "rank")
    w = Window.partitionBy("conversation_uuid").orderBy(*order)
    plain = msgs.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("message_uuid", "rank")
    assert rows(got) == rows(plain)


def test_grouped_bounded_quantiles_equal_percentile(spark, tctx):
    from parley.operators.quantiles import grouped_quantiles

    m = tctx.stats.message
    exact = grouped_quantiles(m, ["sender"], F.col("chars_text"), (0.5, 0.9), Config(quantile_mode="exact"))
    bounded = grouped_quantiles(m, ["sender"], F.col("chars_text"), (0.5, 0.9), Config(bounded_accuracy=2))
    assert rows(bounded) == rows(exact)


def test_chunked_windows_with_null_keys(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    data = [("g", f"m{i:02d}", i, None if i % 4 == 0 else base + dt.timedelta(minutes=37 * i)) for i in range(20)]
    data += [("h", f"n{i}", i, base + dt.timedelta(hours=i)) for i in range(3)]
    df = spark.createDataFrame(data, "conversation_uuid string, message_uuid string, position int, created_at timestamp")
    w = Window.partitionBy("conversation_uuid").orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])
    plain = df.select("message_uuid", F.lag("position").over(w).alias("p"), F.row_number().over(w).cast("long").alias("rn"))
    lag = lag_within(df, "conversation_uuid", ORDER, ["position"], 3).select("message_uuid", F.col("prev_position").alias("p"))
    rn = row_number_within(df, "conversation_uuid", ORDER, "rn", 3).select("message_uuid", "rn")
    assert rows(lag.join(rn, "message_uuid")) == rows(plain)


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 5)), min_size=1, max_size=80),
       k=st.integers(1, 4), target=st.integers(1, 10))
def test_top_k_per_group_property(spark, data, k, target):
    from parley.operators.ranking import top_k_per_group

    rows_in = [(g, f"id{i:03d}", v) for i, (g, v) in enumerate(data)]
    df = spark.createDataFrame(rows_in, "g string, id string, v int")
    got = top_k_per_group(df, ["g"], k, [F.desc("v"), F.asc("id")], "rank", target).select("g", "id", "rank")
    want = []
    for g in sorted({r[0] for r in rows_in}):
        ordered = sorted((r for r in rows_in if r[0] == g), key=lambda r: (-r[2], r[1]))[:k]
        want += [(g, r[1], i + 1) for i, r in enumerate(ordered)]
    assert rows(got) == sorted(want)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.sampled_from(["a", "b"]), st.one_of(st.none(), st.integers(0, 30)),
                               st.sampled_from(["human", "assistant"])), min_size=1, max_size=60),
       target=st.integers(1, 8))
def test_chunked_windows_property(spark, data, target):
    rows_in = [(g, f"id{i:03d}", i, t, s) for i, (g, t, s) in enumerate(data)]
    df = spark.createDataFrame(rows_in, "g string, id string, pos int, t int, s string")
    order = ["t", "pos", "id"]
    w = Window.partitionBy("g").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    after = w.rowsBetween(1, Window.unboundedFollowing)
    v = F.when(F.col("s") == "human", F.col("pos"))
    plain = df.select("id", F.lag("pos").over(w).alias("p"), F.min(v).over(after).alias("nh"))
    got = (lag_within(df, "g", order, ["pos"], target).select("id", F.col("prev_pos").alias("p"))
           .join(min_after(df, "g", order, {"nh": v}, target).select("id", "nh"), "id"))
    assert rows(got) == rows(plain)


def _follow_ups(rows_):
    """Loop version: rows (id, g, pos, s) -> id -> (next human's id, the next assistant's id after it)."""
    out = {}
    for i, g, pos, _ in rows_:
        later = sorted((r for r in rows_ if r[1] == g and _place(r) > _place((i, g, pos, None))), key=_place)
        h = next((r for r in later if r[3] == "human"), None)
        a = next((r for r in later if h and _place(r) > _place(h) and r[3] == "assistant"), None)
        out[i] = (h and h[0], a and a[0])
    return out


def _place(r):
    return (r[2] is None, r[2] or 0, r[0])


@pytest.mark.parametrize("target", [1, 3, 8, 10 ** 9])
def test_follow_ups_in_one_ordering_equal_a_loop(spark, target):
    import random

    from parley.operators.ordered import first_then_after

    draw = random.Random(7)
    data = [(i, draw.choice(["a", "a", "b", None]), draw.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]),
             draw.choice(["human", "assistant", "assistant", "tool", None])) for i in range(60)]
    df = spark.createDataFrame(data, "id long, g string, pos long, s string")
    got = first_then_after(df, "g", ["pos", "id"], F.col("s") == "human", F.col("s") == "assistant", F.col("id"), target)
    assert got.columns == ["id", "g", "pos", "s", "first_after", "then_after"]
    assert {r["id"]: (r["first_after"], r["then_after"]) for r in got.collect()} == _follow_ups(data)


def test_follow_ups_take_one_exchange_and_one_sort(spark, msgs):
    from parley.operators.ordered import first_then_after

    got = first_then_after(msgs, "conversation_uuid", ["position", "message_uuid"], F.col("sender") == "human",
                           F.col("sender") == "assistant", F.col("position"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1


def test_rows_after_of_a_long_group_cost_a_scan(spark):
    """300,000 rows of one group in one window: going through all later rows for each would be 4.5e10 steps."""
    from parley.operators.ordered import first_then_after

    n = 300_000
    df = spark.range(n).select("id", F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, "human").otherwise("assistant").alias("s"))
    got = first_then_after(df, "g", ["id"], F.col("s") == "human", F.col("s") == "assistant", F.col("id"))
    r = got.agg(F.sum("first_after"), F.sum("then_after")).first()
    first = [3 * (i // 3 + 1) for i in range(n) if 3 * (i // 3 + 1) < n]
    assert list(r) == [sum(first), sum(first) + len(first)]
    m = min_after(df, "g", ["id"], {"h": F.when(F.col("s") == "human", F.col("id"))}).agg(F.sum("h")).first()[0]
    assert m == sum(first)
