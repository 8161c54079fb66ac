"""m03 thinking usage: rates, reply length with / without thinking, thinking load."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import time as TM
from parley.operators.ordered import row_number_within
from parley.operators.ranking import order_key
from parley.operators.quantiles import grouped_quantiles
from parley.operators.stats import S, bucket_index, bucketize, r6, summary_stats
from parley.plans.base import Context, report

# Bucket edges (label, lo, hi), half-open.
RESPONSE_BUCKETS = [("<200", 0, 200), ("200–1K", 200, 1000), ("1K–3K", 1000, 3000), ("3K–10K", 3000, 10000),
                    ("10K+", 10000, float("inf"))]
THINKING_BUCKETS = [("<200", 0, 200), ("200–1K", 200, 1000), ("1K–3K", 1000, 3000), ("3K–10K", 3000, 10000),
                    ("10K+", 10000, float("inf"))]
# Labels are English renderings of the source's labels; edges, patterns and members are the source's values.
THINK_SHARE_BUCKETS = [("0% (no thinking)", 0, 1e-9), (">0–20%", 1e-9, 20), ("20–50%", 20, 50),
                       ("50–80%", 50, 80), ("80%+", 80, 100.0001)]
CONVO_THINKING_BUCKETS = [("<1K", 0, 1000), ("1K–5K", 1000, 5000), ("5K–20K", 5000, 20000),
                          ("20K–50K", 20000, 50000), ("50K+", 50000, float("inf"))]

M = "m03"


def _nonempty(ctx: Context):
    return ctx.stats.conversation.where(F.col("message_count") > 0)


def _asst(ctx: Context):
    return ctx.stats.message.where(F.col("sender") == "assistant")


def _pct(num, den):
    return F.when(den == 0, F.lit(0.0)).otherwise(r6(100.0 * num / den))


@report(M, "m03_rate")
def rate(ctx: Context):
    a = _nonempty(ctx).agg(F.count(F.lit(1)).alias("n"), F.count_if("has_thinking").alias("n_thinking"))
    return a.select("n", "n_thinking",
                    F.when(F.col("n") == 0, 0.0).otherwise(r6(F.col("n_thinking") / F.col("n"))).alias("rate"))


@report(M, "m03_monthly")
def monthly(ctx: Context):
    # month of the conversation start in the session zone (not the report zone), as the source does
    return (
        _nonempty(ctx).groupBy(TM.month("created_at").alias("month"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("has_thinking").alias("with_thinking"))
        .select("month", "total", "with_thinking", _pct(F.col("with_thinking"), F.col("total")).alias("pct"))
    )


@report(M, "m03_assistant_rows", row_level=True)
def assistant_rows(ctx: Context):
    # Full rank inside the conversation (a report row per message); ties by position, uuid.
    a = _asst(ctx).select("message_uuid", "conversation_uuid", "tokens_text", "tokens_thinking", "tool_use_count",
                          "created_at", "position")
    r = row_number_within(a, "conversation_uuid", ["created_at", "position", "message_uuid"], "rn_asst",
                          ctx.cfg.window_chunk_rows)
    return r.select("message_uuid", "conversation_uuid", "tokens_text", "tokens_thinking", "tool_use_count",
                    F.col("rn_asst").cast("long").alias("rn_asst"))


def _with_without(ctx: Context):
    th, tk = F.col("tokens_thinking") > 0, F.col("tokens_text") > 0
    return [S("tokens_text", th & tk, thinking="with"), S("tokens_text", ~th & tk, thinking="without")]


@report(M, "m03_response_len")
def response_len(ctx: Context):
    return summary_stats(_asst(ctx), _with_without(ctx), ctx.cfg)


@report(M, "m03_response_len_buckets")
def response_len_buckets(ctx: Context):
    return bucketize(_asst(ctx), _with_without(ctx), RESPONSE_BUCKETS)


@report(M, "m03_thinking_len")
def thinking_len(ctx: Context):
    return summary_stats(_asst(ctx), [S("tokens_thinking", F.col("tokens_thinking") > 0)], ctx.cfg)


@report(M, "m03_thinking_len_buckets")
def thinking_len_buckets(ctx: Context):
    return bucketize(_asst(ctx), [S("tokens_thinking", F.col("tokens_thinking") > 0)], THINKING_BUCKETS)


def _share_rows(ctx: Context):
    tt, th = F.col("tokens_text"), F.col("tokens_thinking")
    return _asst(ctx).where(tt > 0).select(
        "tokens_text", "tokens_thinking",
        F.when(tt + th > 0, 100.0 * th / (tt + th)).otherwise(0.0).alias("share_pct"))


@report(M, "m03_share")
def share(ctx: Context):
    return bucketize(_share_rows(ctx), [S("share_pct")], THINK_SHARE_BUCKETS)


@report(M, "m03_share_overall")
def share_overall(ctx: Context):
    a = _share_rows(ctx).agg(F.sum("tokens_text").alias("tt"), F.sum("tokens_thinking").alias("th"))
    tt, th = F.coalesce(F.col("tt"), F.lit(0)), F.coalesce(F.col("th"), F.lit(0))
    return a.select(tt.cast("long").alias("tokens_text"), th.cast("long").alias("tokens_thinking"),
                    _pct(th, tt + th).alias("thinking_share_pct"))


def _load_rows(ctx: Context):
    return _nonempty(ctx).where(F.col("has_thinking"))


@report(M, "m03_convo_load")
def convo_load(ctx: Context):
    return summary_stats(_load_rows(ctx), [S("tokens_thinking_total")], ctx.cfg)


@report(M, "m03_convo_load_buckets")
def convo_load_buckets(ctx: Context):
    return bucketize(_load_rows(ctx), [S("tokens_thinking_total")], CONVO_THINKING_BUCKETS)


@report(M, "m03_contingency")
def contingency(ctx: Context):
    th, tl = F.col("has_thinking"), F.col("tool_calls_total") > 0
    a = _nonempty(ctx).agg(
        F.count_if(th & tl).alias("thinking_tool"), F.count_if(th & ~tl).alias("thinking_no_tool"),
        F.count_if(~th & tl).alias("no_thinking_tool"), F.count_if(~th & ~tl).alias("no_thinking_no_tool"),
    )
    tt, tf, ft, ff = (F.col(c) for c in ("thinking_tool", "thinking_no_tool", "no_thinking_tool", "no_thinking_no_tool"))
    return a.select(
        "thinking_tool", "thinking_no_tool", "no_thinking_tool", "no_thinking_no_tool",
        _pct(tt, tt + tf).alias("pct_tool_given_thinking"),
        _pct(ft, ft + ff).alias("pct_tool_given_no_thinking"),
        _pct(tt, tt + ft).alias("pct_thinking_given_tool"),
        _pct(tf, tf + ff).alias("pct_thinking_given_no_tool"),
    )


@report(M, "m03_first_rest")
def first_rest(ctx: Context):
    th = F.coalesce(F.col("tokens_thinking") > 0, F.lit(False))
    first = F.min(F.struct(order_key("created_at", "position", "message_uuid").alias("k"), th.alias("th")))["th"]
    per = _asst(ctx).groupBy("conversation_uuid").agg(first.alias("f"), F.count(F.lit(1)).alias("n"),
                                                      F.count_if(th).alias("t"))
    n1, t1 = F.count(F.lit(1)), F.count_if("f")
    g = per.agg(n1.alias("n_first"), t1.alias("n_first_thinking"),
                (F.coalesce(F.sum("n"), F.lit(0)) - n1).alias("n_rest"),
                (F.coalesce(F.sum("t"), F.lit(0)) - t1).alias("n_rest_thinking"))
    return g.select("n_first", "n_first_thinking", _pct(F.col("n_first_thinking"), F.col("n_first")).alias("pct_first"),
                    "n_rest", "n_rest_thinking", _pct(F.col("n_rest_thinking"), F.col("n_rest")).alias("pct_rest"))


@report(M, "m03_resp_by_bucket")
def resp_by_bucket(ctx: Context):
    th, tt = F.col("tokens_thinking"), F.col("tokens_text")
    # messages without thinking or outside every bucket have no index
    b = _asst(ctx).select(F.when(th > 0, bucket_index(th, THINKING_BUCKETS)).alias("bucket_index"),
                          F.when(tt > 0, tt).alias("resp")).where(F.col("bucket_index").isNotNull())
    q = grouped_quantiles(b, ["bucket_index"], F.col("resp"), (0.5, 0.9), ctx.cfg, few_groups=True)
    g = b.groupBy("bucket_index").agg(F.count(F.lit(1)).alias("n"), F.max("resp").alias("x"))
    names = F.inline(F.array(*[F.struct(F.lit(j).alias("bucket_index"), F.lit(label).alias("bucket"))
                               for j, (label, _, _) in enumerate(THINKING_BUCKETS)]))
    every = ctx.spark.range(1).select(names)
    return every.join(g, "bucket_index", "left").join(q, "bucket_index", "left").select(
        "bucket_index", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        r6(F.col("p50")).alias("resp_p50"), r6(F.col("p90")).alias("resp_p90"), r6(F.col("x")).alias("resp_max"))
