"""S1-S15 exposed as report frames (timestamps rendered as text for portable output)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.stats import r6
from parley.plans import prepare
from parley.plans.base import Context, report

M = "prepare"
TS_FMT = "yyyy-MM-dd HH:mm:ss"


@report(M, "stats_message_base", row_level=True)
def message_base(ctx: Context):
    return ctx.stats.message.select(
        "message_uuid", "conversation_uuid", "sender", "chars_text", "chars_thinking", "tool_use_count",
        "tool_result_count", "attachment_count", "file_count",
        F.date_format("created_local", TS_FMT).alias("created_local"))


@report(M, "message_text", needs=("blocks",), row_level=True)
def message_text(ctx: Context):
    """Ordered text / thinking of each message (export input: built from content blocks)."""
    return ctx.tables.messages.select("message_uuid", "text", "thinking", "chars_text", "chars_thinking")


@report(M, "message_tokens", row_level=True)
def message_tokens(ctx: Context):
    return ctx.stats.message.select("message_uuid", "tokens_text", "tokens_thinking", "chars_code", "tokens_code")


@report(M, "code_concat", row_level=True)
def code_concat(ctx: Context):
    """All fenced bodies of the message text joined by a blank line."""
    code = T.code_concat("text")
    return ctx.tables.messages.select("message_uuid", code.alias("code"), F.length(code).cast("long").alias("chars_code"))


@report(M, "code_blocks", row_level=True)
def code_blocks(ctx: Context):
    return ctx.stats.code_block.select("message_uuid", "conversation_uuid", "sender", "position", "language",
                                       "chars", "tokens")


@report(M, "inline_code_count", row_level=True)
def inline_code_count(ctx: Context):
    return ctx.stats.message.select("message_uuid", "inline_code_count")


@report(M, "inplace_edit", row_level=True)
def inplace_edit(ctx: Context):
    return ctx.stats.message.select("message_uuid", r6(F.col("edit_delta_seconds")).alias("edit_delta_seconds"),
                                    "inplace_edit_flag")


@report(M, "child_count", row_level=True)
def child_count(ctx: Context):
    return prepare.child_counts(ctx.tables.messages).select(
        F.col("puuid").alias("parent_message_uuid"), "child_count")


@report(M, "fork_flags", row_level=True)
def fork_flags(ctx: Context):
    return ctx.stats.message.select("message_uuid", "fork_parent_flag", "fork_child_flag", "fork_child_continued")


@report(M, "root_sender_forks", row_level=True)
def root_sender_forks(ctx: Context):
    return ctx.stats.conversation.select("conversation_uuid", "root_count", "human_fork_count",
                                         "assistant_fork_count", "inplace_edit_count")


@report(M, "stats_conversation", row_level=True)
def stats_conversation(ctx: Context):
    c = ctx.stats.conversation
    ts = {"created_at", "created_local", "first_msg_at", "last_msg_at"}
    cols = [F.date_format(x, TS_FMT).alias(x) if x in ts else
            (r6(F.col(x)).alias(x) if x == "lifetime_seconds" else F.col(x)) for x in c.columns]
    return c.select(*cols)


@report(M, "stats_sanity")
def stats_sanity(ctx: Context):
    return prepare.sanity(ctx.stats)
