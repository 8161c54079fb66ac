"""Overview: scope, projects, senders, block types, monthly new conversations, portrait."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import time as TM
from parley.operators.stats import r6
from parley.plans.base import Context, report

M = "overview"
TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _nonempty(ctx: Context):
    return ctx.stats.conversation.where(F.col("message_count") > 0)


@report(M, "overview_scope")
def scope(ctx: Context):
    return _nonempty(ctx).agg(
        F.count(F.lit(1)).alias("conversations"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"),
        F.date_format(F.min("first_msg_at"), TS_FMT).alias("first_msg_at"),
        F.date_format(F.max("last_msg_at"), TS_FMT).alias("last_msg_at"),
        r6(F.avg("message_count")).alias("msg_mean"), F.max("message_count").alias("msg_max"))


@report(M, "overview_projects", needs=("projects", "docs"))
def projects(ctx: Context):
    p = ctx.tables.projects.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_private").alias("private"),
        F.count_if(F.col("prompt_template").isNotNull() & (F.length("prompt_template") > 0))
        .alias("with_instructions"))
    return p.select("*", ctx.tables.docs.agg(F.count(F.lit(1))).scalar().alias("docs"))


@report(M, "overview_senders")
def senders(ctx: Context):
    return ctx.stats.message.groupBy("sender").agg(F.count(F.lit(1)).alias("n"))


@report(M, "overview_blocks", needs=("blocks",))
def blocks(ctx: Context):
    return ctx.tables.blocks.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@report(M, "overview_monthly")
def monthly(ctx: Context):
    return _nonempty(ctx).groupBy(TM.month("created_local").alias("month")).agg(
        F.count(F.lit(1)).alias("conversations"))


@report(M, "overview_portrait", needs=("tool_calls",))
def portrait(ctx: Context):
    """Peak month (first maximum), inclusive month span (>= 1), assistant share, tool-use and
    thinking totals (tool calls; messages carrying thinking)."""
    c = _nonempty(ctx)
    mon = monthly(ctx)
    # first maximum: most conversations, the earliest month on ties
    peak = mon.agg(F.min(F.struct((-F.col("conversations")).alias("neg"), F.col("month").alias("month"))).alias("b"))
    m = ctx.stats.message.agg(F.struct(
        F.count_if(F.col("sender") == "human").alias("human"),
        F.count_if(F.col("sender") == "assistant").alias("assistant"),
        F.count(F.lit(1)).alias("sender_total"),
        F.count_if(F.col("chars_thinking") > 0).alias("thinking"))).scalar()
    span = c.agg(F.min("first_msg_at").alias("f"), F.max("last_msg_at").alias("l")).select(
        F.date_format("f", "yyyy-MM-dd").alias("first"), F.date_format("l", "yyyy-MM-dd").alias("last"),
        F.when(F.col("f").isNull() | F.col("l").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), (
            (F.year("l") - F.year("f")) * 12 + F.month("l") - F.month("f") + 1))).alias("months"))
    tool_use = ctx.tables.tool_calls.agg(F.count(F.lit(1))).scalar()
    h, a, t = m["human"], m["assistant"], m["sender_total"]
    pk = peak.select("b").scalar()
    return span.select(
        "first", "last", "months",
        pk["month"].alias("peak_month"),
        (-pk["neg"]).cast("long").alias("peak_conversations"),
        h.alias("human"), a.alias("assistant"), t.alias("sender_total"),
        F.when(t == 0, F.lit(None).cast("double")).otherwise(r6(100.0 * a / t)).alias("assistant_share"),
        tool_use.alias("tool_use"), m["thinking"].alias("thinking"))
