"""m05 tool intensity: calls per conversation, diversity, top tools, categories, errors, durations."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import time as TM
from parley.functions.categorize import member_category, strip_server_prefix
from parley.operators.grid import axis, cells, dense_rows, names_array
from parley.operators.ranking import top_k
from parley.operators.stats import S, bucketize, cohort_compare, r6, summary_stats
from parley.plans.base import Context, report

# Bucket edges (label, lo, hi), half-open.
TOOL_BUCKETS = [("0", 0, 1), ("1", 1, 2), ("2–9", 2, 10), ("10–49", 10, 50), ("50+", 50, float("inf"))]
DIVERSITY_BUCKETS = [("0", 0, 1), ("1", 1, 2), ("2–3", 2, 4), ("4–6", 4, 7), ("7+", 7, float("inf"))]
# Labels are English renderings of the source's labels; edges, patterns and members are the source's values.
DURATION_BUCKETS = [("<1s", 0, 1), ("1–5s", 1, 5), ("5–30s", 5, 30), ("30s–2m", 30, 120), ("2m+", 120, float("inf"))]
# Explicit tool-name membership per category (server prefix removed first);
# category names are English renderings of the source's names, members are the source's.
TOOL_CATEGORIES = [
    ("file write", ["write_file", "create_file", "str_replace", "edit_file"]),
    ("file read", ["read_file", "read_text_file", "view"]),
    ("execute", ["bash_tool", "repl"]),
    ("web", ["web_search", "web_fetch"]),
    ("artifact", ["artifacts", "present_files"]),
    ("directory", ["create_directory", "list_directory", "directory_tree"]),
    ("search", ["grep", "glob", "search_files"]),
    ("other", []),
]
TOP_TOOLS = 15
TOP_MONTHLY = 5
TOP_ERRORS = 15

M = "m05"


def _nonempty(ctx: Context):
    return ctx.stats.conversation.where(F.col("message_count") > 0)


@report(M, "m05_per_convo")
def per_convo(ctx: Context):
    t = F.col("tool_calls_total")
    return summary_stats(_nonempty(ctx), [S(t, population="all"), S(t, t > 0, population="with_tools")], ctx.cfg)


@report(M, "m05_per_convo_buckets")
def per_convo_buckets(ctx: Context):
    return bucketize(_nonempty(ctx), [S("tool_calls_total")], TOOL_BUCKETS)


@report(M, "m05_length_compare")
def length_compare(ctx: Context):
    c = _nonempty(ctx)
    return cohort_compare(c, F.col("tool_calls_total") > 0,
                          {"message_count": F.col("message_count"),
                           "tokens": F.col("tokens_human") + F.col("tokens_assistant")},
                          labels=("with_tools", "without_tools"), cfg=ctx.cfg)


def _diversity(ctx: Context):
    d = (ctx.tables.tool_calls.where(F.col("name").isNotNull())
         .groupBy("conversation_uuid").agg(F.countDistinct("name").alias("n_distinct")))
    return (_nonempty(ctx).select("conversation_uuid").join(d, "conversation_uuid", "left")
            .select("conversation_uuid", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")))


@report(M, "m05_diversity")
def diversity(ctx: Context):
    return summary_stats(_diversity(ctx), [S("n_distinct", F.col("n_distinct") > 0)], ctx.cfg)


@report(M, "m05_diversity_buckets")
def diversity_buckets(ctx: Context):
    return bucketize(_diversity(ctx), [S("n_distinct")], DIVERSITY_BUCKETS)


def _tool_counts(ctx: Context):
    return (ctx.tables.tool_calls.where(F.col("name").isNotNull()).groupBy("name")
            .agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("conversation_uuid").alias("conversations")))


@report(M, "m05_top_tools")
def top_tools(ctx: Context):
    # every call counts in the total, those without a name too; the second scan reads no column
    total = ctx.tables.tool_calls.agg(F.count(F.lit(1))).scalar()
    top = top_k(_tool_counts(ctx), TOP_TOOLS, [F.desc("calls"), F.asc("name")])
    return top.select(
        "name", "calls", "conversations",
        F.when(F.col("conversations") == 0, 0.0).otherwise(r6(F.col("calls") / F.col("conversations")))
        .alias("calls_per_conversation"),
        r6(100.0 * F.col("calls") / F.greatest(total, F.lit(1))).alias("share_pct"),
    )


@report(M, "m05_categories")
def categories(ctx: Context):
    per_name = ctx.tables.tool_calls.where(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    cat = member_category(strip_server_prefix("name"), TOOL_CATEGORIES, "other")
    per_cat = per_name.groupBy(cat.alias("category")).agg(
        F.sum("n").alias("calls"), F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("members"))
    labels = [c for c, _ in TOOL_CATEGORIES]
    grid = cells(ctx.spark.range(1).select(), {"category": axis(labels)})
    j = grid.join(per_cat, "category", "left")
    total = per_name.agg(F.sum("n")).scalar()
    calls = F.coalesce(F.col("calls"), F.lit(0)).cast("long")
    idx = F.array_position(axis(labels), F.col("category")).cast("int") - 1
    return j.select(
        idx.alias("category_index"), "category", calls.alias("calls"),
        r6(100.0 * calls / F.greatest(F.coalesce(total, F.lit(0)), F.lit(1))).alias("share_pct"),
        F.coalesce(F.col("members"), F.lit("")).alias("members"),
    )


@report(M, "m05_monthly_top5")
def monthly_top5(ctx: Context):
    tc = ctx.tables.tool_calls
    top = top_k(_tool_counts(ctx), TOP_MONTHLY, [F.desc("calls"), F.asc("name")])
    calls = (tc.where(F.col("start_timestamp").isNotNull())
             .join(F.broadcast(top.select("name")), "name", "left_semi")  # <= 5 rows: bounded broadcast
             .select(TM.month(TM.local("start_timestamp", ctx.cfg.tz)).alias("month"), "name"))
    counts = calls.groupBy("month", "name").agg(F.count(F.lit(1)).alias("calls"))
    order = F.struct((-F.col("calls")).alias("c"), F.col("name").alias("n"))
    return dense_rows(counts, "month", "name", "calls", names_array(top, "name", order))


@report(M, "m05_error_rate")
def error_rate(ctx: Context):
    a = ctx.tables.tool_results.agg(F.count(F.lit(1)).alias("results"), F.count_if("is_error").alias("errors"))
    return a.select("results", "errors",
                    F.when(F.col("results") == 0, 0.0).otherwise(r6(100.0 * F.col("errors") / F.col("results")))
                    .alias("error_pct"))


@report(M, "m05_error_by_tool")
def error_by_tool(ctx: Context):
    g = (ctx.tables.tool_results.where(F.col("name").isNotNull()).groupBy("name")
         .agg(F.count(F.lit(1)).alias("total"), F.count_if("is_error").alias("errors"))
         .where(F.col("errors") > 0))
    return top_k(g, TOP_ERRORS, [F.desc("errors"), F.asc("name")])


def _durations(ctx: Context):
    d = F.col("duration_s")
    return ctx.tables.tool_calls.where(d.isNotNull() & (d >= 0)).select("duration_s")


@report(M, "m05_duration")
def duration(ctx: Context):
    return summary_stats(_durations(ctx), [S("duration_s")], ctx.cfg)


@report(M, "m05_duration_buckets")
def duration_buckets(ctx: Context):
    return bucketize(_durations(ctx), [S("duration_s")], DURATION_BUCKETS)
