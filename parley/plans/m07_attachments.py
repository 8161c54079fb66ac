"""m07 attachments and files: monthly counts, attach rate, types, sizes, per conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import time as TM
from parley.operators.grid import dense_rows, names_array
from parley.operators.quantiles import grouped_quantiles
from parley.operators.ranking import order_key, top_k
from parley.operators.stats import S, bucketize, cohort_compare, r6, summary_stats
from parley.plans.base import Context, report

# Bucket edges (label, lo, hi), half-open.
SIZE_BUCKETS = [("<1 KB", 0, 1024), ("1–10 KB", 1024, 10240), ("10–100 KB", 10240, 102400),
                ("100 KB–1 MB", 102400, 1048576), (">1 MB", 1048576, float("inf"))]
PER_CONVO_BUCKETS = [("1", 1, 2), ("2–5", 2, 6), ("6–15", 6, 16), ("16+", 16, float("inf"))]
UNKNOWN_TYPE = "(unknown)"
TOP_TYPES = 8
TOP_TYPES_MONTHLY = 4
TOP_TYPE_SIZE = 6

M = "m07"


def _nonempty(ctx: Context):
    return ctx.stats.conversation.where(F.col("message_count") > 0)


@report(M, "m07_monthly")
def monthly(ctx: Context):
    """Attachment and file rows per local month. Default counts each side per message (no
    join fan-out); cfg.fanout_m07 reproduces the a x f rows of joining both sides at once."""
    a, f = F.col("attachment_count"), F.col("file_count")
    if ctx.cfg.fanout_m07:
        att = F.when(a > 0, a * F.greatest(f, F.lit(1))).otherwise(0)
        fil = F.when(f > 0, f * F.greatest(a, F.lit(1))).otherwise(0)
    else:
        att, fil = a, f
    m = ctx.stats.message.select(TM.month("created_local").alias("month"), att.alias("a"), fil.alias("f"))
    return m.groupBy("month").agg(F.sum("a").cast("long").alias("attachments"), F.sum("f").cast("long").alias("files"))


@report(M, "m07_attach_rate")
def attach_rate(ctx: Context):
    c = _nonempty(ctx).select(TM.month("created_local").alias("month"),
                              ((F.col("attachment_total") + F.col("file_total")) > 0).alias("has_items"))
    g = c.groupBy("month").agg(F.count(F.lit(1)).alias("total"), F.count_if("has_items").alias("with_items"))
    return g.select("month", "total", "with_items",
                    F.when(F.col("total") == 0, 0.0).otherwise(r6(100.0 * F.col("with_items") / F.col("total")))
                    .alias("pct"))


def _typed(ctx: Context):
    return ctx.tables.attachments.select(
        "message_uuid", "file_size",
        F.coalesce(F.nullif(F.col("file_type"), F.lit("")), F.lit(UNKNOWN_TYPE)).alias("file_type"))


def _type_counts(ctx: Context):
    return _typed(ctx).groupBy("file_type").agg(F.count(F.lit(1)).alias("n"))


@report(M, "m07_top_types", needs=("attachments",))
def top_types(ctx: Context):
    counts = _type_counts(ctx)
    total = F.coalesce(counts.agg(F.sum("n")).scalar(), F.lit(0))
    return top_k(counts, TOP_TYPES, [F.desc("n"), F.asc("file_type")]).select(
        "file_type", "n", F.when(total == 0, 0.0).otherwise(r6(100.0 * F.col("n") / total)).alias("pct"))


@report(M, "m07_type_monthly", needs=("attachments",))
def type_monthly(ctx: Context):
    top = top_k(_type_counts(ctx), TOP_TYPES_MONTHLY, [F.desc("n"), F.asc("file_type")])
    rows = (_typed(ctx).join(F.broadcast(top.select("file_type")), "file_type", "left_semi")  # <= 4 rows
            .join(ctx.stats.message.select("message_uuid", "created_local"), "message_uuid")
            .select(TM.month("created_local").alias("month"), "file_type"))
    counts = rows.groupBy("month", "file_type").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("n")).alias("c"), F.col("file_type").alias("t"))
    return dense_rows(counts, "month", "file_type", "n", names_array(top, "file_type", order))


def _sized(ctx: Context):
    return _typed(ctx).where(F.col("file_size").isNotNull() & (F.col("file_size") > 0))


@report(M, "m07_size", needs=("attachments",))
def size(ctx: Context):
    return summary_stats(_sized(ctx), [S("file_size")], ctx.cfg)


@report(M, "m07_size_buckets", needs=("attachments",))
def size_buckets(ctx: Context):
    return bucketize(_sized(ctx), [S("file_size")], SIZE_BUCKETS)


def _per_convo_series():
    a, f = F.col("attachment_total"), F.col("file_total")
    return [S(a, a > 0, kind="attachments"), S(f, f > 0, kind="files")]


@report(M, "m07_per_convo")
def per_convo(ctx: Context):
    return summary_stats(_nonempty(ctx), _per_convo_series(), ctx.cfg)


@report(M, "m07_per_convo_buckets")
def per_convo_buckets(ctx: Context):
    return bucketize(_nonempty(ctx), _per_convo_series(), PER_CONVO_BUCKETS)


@report(M, "m07_compare")
def compare(ctx: Context):
    return cohort_compare(_nonempty(ctx), (F.col("attachment_total") + F.col("file_total")) > 0,
                          {"message_count": F.col("message_count"),
                           "tokens": F.col("tokens_human") + F.col("tokens_assistant")},
                          labels=("with_items", "without_items"), cfg=ctx.cfg)


@report(M, "m07_first_human")
def first_human(ctx: Context):
    h = ctx.stats.message.where(F.col("sender") == "human")
    item = (F.col("attachment_count") > 0) | (F.col("file_count") > 0)
    key = order_key("created_at", "position", "message_uuid")
    f = h.groupBy("conversation_uuid").agg(F.min(F.struct(key.alias("k"), item.alias("item")))["item"].alias("item"))
    g = f.agg(F.count(F.lit(1)).alias("n"), F.count_if("item").alias("with_item"))
    return g.select("n", "with_item",
                    F.when(F.col("n") == 0, 0.0).otherwise(r6(100.0 * F.col("with_item") / F.col("n"))).alias("pct"))


@report(M, "m07_type_size", needs=("attachments",))
def type_size(ctx: Context):
    sized = _sized(ctx)
    g = sized.groupBy("file_type").agg(F.count(F.lit(1)).alias("n"), F.max("file_size").alias("size_max"))
    top = top_k(g, TOP_TYPE_SIZE, [F.desc("n"), F.asc("file_type")])
    # byte sizes: distinct values grow with the data -> bounded exact quantiles, top types only
    rows = sized.join(F.broadcast(top.select("file_type")), "file_type", "left_semi")  # <= 6 rows
    q = grouped_quantiles(rows, ["file_type"], F.col("file_size"), (0.5, 0.95), ctx.cfg, few_groups=True)
    return top.join(q, "file_type", "left").select(
        "file_type", "n", r6(F.col("p50")).alias("size_p50"), r6(F.col("p95")).alias("size_p95"),
        F.col("size_max").cast("long").alias("size_max"))


@report(M, "m07_totals")
def totals(ctx: Context):
    c = _nonempty(ctx).agg(
        F.count_if(F.col("attachment_total") > 0).alias("conversations_with_attachments"),
        F.count_if(F.col("file_total") > 0).alias("conversations_with_files"),
        F.count(F.lit(1)).alias("conversations"))
    m = ctx.stats.message.agg(F.struct(F.sum("attachment_count").cast("long").alias("attachments"),
                                       F.sum("file_count").cast("long").alias("files"))).scalar()
    return c.select(m["attachments"].alias("attachments"), m["files"].alias("files"),
                    "conversations_with_attachments", "conversations_with_files", "conversations")
