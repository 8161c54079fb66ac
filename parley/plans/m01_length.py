"""m01 conversation length: message count, human turns, tokens per conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators.stats import S, bucketize, summary_stats
from parley.plans.base import Context, report

# Bucket edges (label, lo, hi) — half-open [lo, hi).
MSG_BUCKETS = [("1", 1, 2), ("2–5", 2, 6), ("6–15", 6, 16), ("16–50", 16, 51), ("51–100", 51, 101), ("101+", 101, float("inf"))]
TURN_BUCKETS = [("1", 1, 2), ("2–5", 2, 6), ("6–15", 6, 16), ("16–50", 16, 51), ("51+", 51, float("inf"))]
TOKEN_BUCKETS = [("<500", 0, 500), ("500–2K", 500, 2000), ("2K–10K", 2000, 10000), ("10K–50K", 10000, 50000),
                 ("50K+", 50000, float("inf"))]

M = "m01"


def _conv(ctx: Context):
    return ctx.stats.conversation.select(
        "conversation_uuid", "message_count", "human_turn_count",
        (F.col("tokens_human") + F.col("tokens_assistant")).alias("tokens_total"),
    )


@report(M, "m01_data", row_level=True)
def data(ctx: Context):
    return _conv(ctx)


@report(M, "m01_counts")
def counts(ctx: Context):
    return _conv(ctx).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("message_count") == 0).alias("empty"),
        F.count_if(F.col("message_count") > 0).alias("non_empty"),
    )


@report(M, "m01_quantiles")
def quantiles(ctx: Context):
    ne = F.col("message_count") > 0
    return summary_stats(_conv(ctx), [
        S("message_count", ne, metric="message_count"),
        S("human_turn_count", ne & (F.col("human_turn_count") > 0), metric="human_turn_count"),
        S("tokens_total", ne, metric="tokens_total"),
    ], ctx.cfg)


@report(M, "m01_buckets")
def buckets(ctx: Context):
    ne = F.col("message_count") > 0
    return bucketize(_conv(ctx), [
        S("message_count", ne, edges=MSG_BUCKETS, metric="message_count"),
        S("human_turn_count", ne & (F.col("human_turn_count") > 0), edges=TURN_BUCKETS, metric="human_turn_count"),
        S("tokens_total", ne, edges=TOKEN_BUCKETS, metric="tokens_total"),
    ])
