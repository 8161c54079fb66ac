"""m11 citations: totals, types, domains, per conversation, web tool calls vs citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators.ranking import top_k
from parley.operators.stats import S, bucketize, cohort_compare, r6, summary_stats
from parley.plans.base import Context, report

# Bucket edges (label, lo, hi), half-open.
PER_CONVO_BUCKETS = [("1-4", 1, 5), ("5-19", 5, 20), ("20-49", 20, 50), ("50-99", 50, 100), ("100+", 100, float("inf"))]
WEB_TOOLS = ["web_search", "web_fetch"]
TOP_DOMAINS = 20

M = "m11"
NEEDS = ("citations",)


def _cites(ctx: Context):
    return ctx.tables.citations


@report(M, "m11_citations", needs=NEEDS, row_level=True)
def citations(ctx: Context):
    return _cites(ctx).select("conversation_uuid", "message_uuid", "cite_type", "url", "domain")


@report(M, "m11_totals", needs=NEEDS)
def totals(ctx: Context):
    """Four distinct counts; exact ones share one Expand-rewritten aggregation, or HyperLogLog++
    sketches (one pass, fixed memory) with cfg.approx_distinct."""
    def distinct(c):
        return (F.approx_count_distinct(c, 0.01) if ctx.cfg.approx_distinct else F.countDistinct(c)).cast("long")

    return _cites(ctx).agg(
        F.count(F.lit(1)).alias("citations"), distinct("message_uuid").alias("messages"),
        distinct("conversation_uuid").alias("conversations"), distinct("domain").alias("domains"),
        distinct("url").alias("urls"))


@report(M, "m11_types", needs=NEEDS)
def types(ctx: Context):
    return _cites(ctx).groupBy("cite_type").agg(F.count(F.lit(1)).alias("n"))


def _per_convo(ctx: Context):
    return _cites(ctx).groupBy("conversation_uuid").agg(F.count(F.lit(1)).alias("citations"))


@report(M, "m11_per_convo", needs=NEEDS)
def per_convo(ctx: Context):
    return summary_stats(_per_convo(ctx), [S("citations")], ctx.cfg)


@report(M, "m11_per_convo_buckets", needs=NEEDS)
def per_convo_buckets(ctx: Context):
    return bucketize(_per_convo(ctx), [S("citations")], PER_CONVO_BUCKETS)


def _domains(ctx: Context):
    c = _cites(ctx)
    total = c.agg(F.count(F.lit(1))).scalar()
    g = (c.where(F.col("domain").isNotNull() & (F.col("domain") != "")).groupBy("domain")
         .agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("message_uuid").alias("messages"),
              F.countDistinct("conversation_uuid").alias("conversations")))
    return g.select("*", F.when(total == 0, 0.0).otherwise(r6(100.0 * F.col("citations") / total)).alias("pct"))


@report(M, "m11_domains", needs=NEEDS, row_level=True)
def domains(ctx: Context):
    return _domains(ctx)


@report(M, "m11_top_domains", needs=NEEDS)
def top_domains(ctx: Context):
    return top_k(_domains(ctx), TOP_DOMAINS, [F.desc("citations"), F.asc("domain")])


def _web(ctx: Context):
    n = F.col("name")
    return (ctx.tables.tool_calls.where(n.isin(*WEB_TOOLS)).groupBy("conversation_uuid")
            .agg(F.count_if(n == "web_search").alias("web_search_calls"),
                 F.count_if(n == "web_fetch").alias("web_fetch_calls"),
                 F.count(F.lit(1)).alias("web_calls")))


@report(M, "m11_web_calls", needs=NEEDS + ("tool_calls",), row_level=True)
def web_calls(ctx: Context):
    return _web(ctx)


def _scatter(ctx: Context):
    return (_per_convo(ctx).join(_web(ctx).select("conversation_uuid", "web_calls"), "conversation_uuid", "left")
            .select("conversation_uuid", F.coalesce("web_calls", F.lit(0)).alias("web_calls"), "citations"))


@report(M, "m11_scatter", needs=NEEDS + ("tool_calls",), row_level=True)
def scatter(ctx: Context):
    return _scatter(ctx)


@report(M, "m11_pearson", needs=NEEDS + ("tool_calls",))
def pearson(ctx: Context):
    """Pearson r of (web calls, citations) per cited conversation; NULL (NaN) below 2 points
    or with a constant side. covar / stddev instead of corr(): corr raises under ANSI on constants."""
    s = _scatter(ctx)
    x, y = F.col("web_calls").cast("double"), F.col("citations").cast("double")
    a = s.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("web_calls") == 0).alias("without_web_calls"),
              F.covar_pop(x, y).alias("cov"), (F.stddev_pop(x) * F.stddev_pop(y)).alias("den"))
    r = F.when((F.col("points") < 2) | (F.col("den") == 0), F.lit(None).cast("double")).otherwise(
        r6(F.col("cov") / F.col("den")))
    return a.select("points", "without_web_calls", r.alias("pearson_r"))


@report(M, "m11_compare", needs=NEEDS)
def compare(ctx: Context):
    cited = _cites(ctx).select("conversation_uuid").distinct().select("conversation_uuid", F.lit(True).alias("cited"))
    c = ctx.stats.conversation.where(F.col("message_count") > 0).join(cited, "conversation_uuid", "left")
    return cohort_compare(c, F.coalesce(F.col("cited"), F.lit(False)),
                          {"message_count": F.col("message_count"),
                           "tokens": F.col("tokens_human") + F.col("tokens_assistant"),
                           "tool_calls": F.col("tool_calls_total"), "lifetime_s": F.col("lifetime_seconds")},
                          labels=("cited", "not_cited"), cfg=ctx.cfg)


@report(M, "m11_monthly", needs=("blocks",))
def monthly(ctx: Context):
    """Citations per month of the citing block (session zone); export input only (needs block time)."""
    c = _cites(ctx).where(F.col("cited_at").isNotNull())
    return c.groupBy(F.date_format("cited_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("citations"), F.countDistinct("conversation_uuid").alias("conversations"))
