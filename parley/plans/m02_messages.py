"""m02 message length: tokens per sender, first vs follow-up human message, code share."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators.ranking import flag_first
from parley.operators.stats import S, bucketize, r6, summary_stats
from parley.plans.base import Context, report

# Bucket edges (label, lo, hi), half-open.
TOKEN_BUCKETS = [("<50", 0, 50), ("50–200", 50, 200), ("200–1K", 200, 1000), ("1K–5K", 1000, 5000),
                 ("5K+", 5000, float("inf"))]
# Labels are English renderings of the source's labels; edges, patterns and members are the source's values.
CODE_SHARE_BUCKETS = [("0% (no code)", 0, 1e-9), (">0–10%", 1e-9, 10), ("10–30%", 10, 30), ("30–60%", 30, 60),
                      ("60%+", 60, 100.0001)]

M = "m02"
SENDERS = ("human", "assistant")


def _msgs(ctx: Context):
    return ctx.stats.message.where(F.col("sender").isin(*SENDERS))


@report(M, "m02_data", row_level=True)
def data(ctx: Context):
    return _msgs(ctx).select("message_uuid", "sender", "chars_text", "tokens_text", "tokens_code")


@report(M, "m02_quantiles")
def quantiles(ctx: Context):
    snd, tk = F.col("sender"), F.col("tokens_text")
    return summary_stats(_msgs(ctx), [S("tokens_text", (snd == s) & (tk > 0), sender=s) for s in SENDERS], ctx.cfg)


@report(M, "m02_tool_only")
def tool_only(ctx: Context):
    return (
        _msgs(ctx).groupBy("sender")
        .agg(F.count_if(F.col("chars_text") == 0).alias("tool_only"), F.count(F.lit(1)).alias("total"))
    )


@report(M, "m02_buckets")
def buckets(ctx: Context):
    snd, tk = F.col("sender"), F.col("tokens_text")
    return bucketize(_msgs(ctx), [S("tokens_text", (snd == s) & (tk > 0), sender=s) for s in SENDERS], TOKEN_BUCKETS)


@report(M, "m02_volume")
def volume(ctx: Context):
    m = _msgs(ctx)
    a = m.agg(
        F.sum(F.when(F.col("sender") == "human", F.col("tokens_text")).otherwise(0)).alias("h"),
        F.sum(F.when(F.col("sender") == "assistant", F.col("tokens_text")).otherwise(0)).alias("a"),
    )
    h, s = F.coalesce(F.col("h"), F.lit(0)), F.coalesce(F.col("a"), F.lit(0))
    tot = h + s
    return a.select(
        h.cast("long").alias("tokens_human"), s.cast("long").alias("tokens_assistant"),
        F.when(tot == 0, 0.0).otherwise(r6(100.0 * h / tot)).alias("share_human"),
        F.when(tot == 0, 0.0).otherwise(r6(100.0 * s / tot)).alias("share_assistant"),
        # zero human tokens -> infinite ratio, reported as NULL (non-finite values are nulls)
        F.when(h == 0, F.lit(None).cast("double")).otherwise(r6(s / h)).alias("assistant_to_human"),
    )


def _first_followup(ctx: Context):
    hm = _msgs(ctx).where((F.col("sender") == "human") & (F.col("tokens_text") > 0))
    return flag_first(hm, "conversation_uuid", ["created_at", "position"], "message_uuid")


@report(M, "m02_first_followup")
def first_followup(ctx: Context):
    f = F.col("is_first")
    return summary_stats(_first_followup(ctx), [S("tokens_text", f, kind="first"),
                                                S("tokens_text", ~f, kind="followup")], ctx.cfg)


@report(M, "m02_first_followup_buckets")
def first_followup_buckets(ctx: Context):
    f = F.col("is_first")
    return bucketize(_first_followup(ctx), [S("tokens_text", f, kind="first"),
                                            S("tokens_text", ~f, kind="followup")], TOKEN_BUCKETS)


def _asst_nonzero(ctx: Context):
    return ctx.stats.message.where((F.col("sender") == "assistant") & (F.col("tokens_text") > 0)).select(
        "tokens_text", "tokens_code",
        (100.0 * F.col("tokens_code") / F.col("tokens_text")).alias("code_share_pct"))


@report(M, "m02_code_share")
def code_share(ctx: Context):
    return bucketize(_asst_nonzero(ctx), [S("code_share_pct")], CODE_SHARE_BUCKETS)


@report(M, "m02_code_share_summary")
def code_share_summary(ctx: Context):
    a = _asst_nonzero(ctx).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("tokens_text").alias("tt"), F.sum("tokens_code").alias("tc"),
        F.count_if(F.col("tokens_code") > 0).alias("with_code"),
    )
    tt, tc = F.coalesce(F.col("tt"), F.lit(0)), F.coalesce(F.col("tc"), F.lit(0))
    return a.select(
        F.col("n").cast("long").alias("assistant_messages"),
        tt.cast("long").alias("tokens_text"), tc.cast("long").alias("tokens_code"),
        F.when(tt == 0, 0.0).otherwise(r6(100.0 * tc / tt)).alias("code_share_pct"),
        F.col("with_code").cast("long").alias("messages_with_code"),
        F.when(F.col("n") == 0, 0.0).otherwise(r6(100.0 * F.col("with_code") / F.col("n"))).alias("with_code_pct"),
    )


@report(M, "m02_voice_notes", needs=("blocks",))
def voice_notes(ctx: Context):
    """m02.8: distinct messages with a voice_note block (export input only: needs blocks)."""
    b = ctx.tables.blocks
    return b.where(F.col("type") == "voice_note").agg(F.countDistinct("message_uuid").alias("voice_note_messages"))
