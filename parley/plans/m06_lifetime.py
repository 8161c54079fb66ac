"""m06 conversation lifetime: lifetime, gaps between messages, first response delay, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import time as TM
from parley.operators.grid import axis, cells, seq, zero_fill
from parley.operators.ordered import lag_within
from parley.operators.stats import S, bucket_index, bucketize, r6, summary_stats
from parley.plans.base import Context, report

# Bucket edges in seconds / messages (label, lo, hi), half-open.
# Labels are English renderings of the source's labels; edges, patterns and members are the source's values.
LIFETIME_BUCKETS = [("0s (same timestamp)", 0, 1), ("<1m", 1, 60), ("1–10m", 60, 600), ("10m–1h", 600, 3600),
                    ("1–24h", 3600, 86400), ("1–7d", 86400, 604800), (">7d", 604800, float("inf"))]
GAP_BUCKETS = [("<10s", 0, 10), ("10–60s", 10, 60), ("1–10m", 60, 600), ("10m–1h", 600, 3600),
               ("1–24h", 3600, 86400), (">1d", 86400, float("inf"))]
RESP_BUCKETS = GAP_BUCKETS
MSG_BUCKETS = [("2–5", 2, 6), ("6–15", 6, 16), ("16–50", 16, 51), ("51+", 51, float("inf"))]
SESSION_GAP_S = 3600

M = "m06"


def _multi(ctx: Context):
    return ctx.stats.conversation.where(F.col("message_count") >= 2)


@report(M, "m06_lifetime_counts")
def lifetime_counts(ctx: Context):
    return _multi(ctx).agg(F.count(F.lit(1)).alias("n"),
                           F.count_if(F.col("lifetime_seconds") == 0).alias("zero_lifetime"))


@report(M, "m06_lifetime")
def lifetime(ctx: Context):
    return summary_stats(_multi(ctx), [S("lifetime_seconds", F.col("lifetime_seconds") > 0)], ctx.cfg)


@report(M, "m06_lifetime_buckets")
def lifetime_buckets(ctx: Context):
    return bucketize(_multi(ctx), [S("lifetime_seconds")], LIFETIME_BUCKETS)


def _gaps(ctx: Context):
    """Consecutive human/assistant messages of a conversation by time (ties: position, uuid);
    shared by five reports, so built once per dataset."""
    return ctx.derived("gaps", lambda: _build_gaps(ctx))


def _build_gaps(ctx: Context):
    m = ctx.stats.message.where(F.col("sender").isin("human", "assistant")).select(
        "conversation_uuid", "message_uuid", "position", "sender", "created_at")
    g = lag_within(m, "conversation_uuid", ["created_at", "position", "message_uuid"], ["created_at", "sender"],
                   ctx.cfg.window_chunk_rows)
    return g.where(F.col("prev_created_at").isNotNull()).select(
        "conversation_uuid", "sender", F.col("prev_sender"),
        TM.epoch_seconds_between("created_at", "prev_created_at").alias("gap_s"))


def _positive_gaps(ctx: Context):
    return _gaps(ctx).where(F.col("gap_s") > 0)


def _responses(ctx: Context):
    return _positive_gaps(ctx).where((F.col("prev_sender") == "human") & (F.col("sender") == "assistant"))


@report(M, "m06_gaps")
def gaps(ctx: Context):
    return summary_stats(_positive_gaps(ctx), [S("gap_s")], ctx.cfg)


@report(M, "m06_gaps_buckets")
def gaps_buckets(ctx: Context):
    return bucketize(_positive_gaps(ctx), [S("gap_s")], GAP_BUCKETS)


@report(M, "m06_first_response")
def first_response(ctx: Context):
    return summary_stats(_responses(ctx), [S("gap_s")], ctx.cfg)


@report(M, "m06_first_response_buckets")
def first_response_buckets(ctx: Context):
    return bucketize(_responses(ctx), [S("gap_s")], RESP_BUCKETS)


@report(M, "m06_multi_session")
def multi_session(ctx: Context):
    multi = _gaps(ctx).where(F.col("gap_s") > SESSION_GAP_S).agg(
        F.countDistinct("conversation_uuid").alias("multi_session")).scalar()
    return _multi(ctx).agg(F.count(F.lit(1)).alias("n")).select(
        multi.alias("multi_session"), "n",
        F.when(F.col("n") == 0, 0.0).otherwise(r6(100.0 * multi / F.col("n"))).alias("pct"))


@report(M, "m06_crosstab")
def crosstab(ctx: Context):
    c = _multi(ctx).select(bucket_index(F.col("lifetime_seconds"), LIFETIME_BUCKETS).alias("li"),
                           bucket_index(F.col("message_count"), MSG_BUCKETS).alias("mi"))
    counts = c.where(F.col("li").isNotNull() & F.col("mi").isNotNull()).groupBy("li", "mi").agg(
        F.count(F.lit(1)).alias("n"))
    grid = cells(ctx.spark.range(1).select(), {"li": seq(0, len(LIFETIME_BUCKETS) - 1),
                                                "mi": seq(0, len(MSG_BUCKETS) - 1)})
    dense = zero_fill(grid, counts, ["li", "mi"], ["n"])
    return dense.select(
        F.col("li").alias("lifetime_bucket_index"),
        axis([b[0] for b in LIFETIME_BUCKETS])[F.col("li")].alias("lifetime_bucket"),
        F.col("mi").alias("msg_bucket_index"),
        axis([b[0] for b in MSG_BUCKETS])[F.col("mi")].alias("msg_bucket"),
        "n",
        F.sum("n").over(Window.partitionBy("li")).alias("row_total"),
    )
