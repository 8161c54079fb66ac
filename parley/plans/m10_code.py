"""m10 code blocks: fenced block totals, per sender, sizes, languages, code-heavy conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.categorize import map_alias
from parley.operators.grid import axis, cells, zero_fill
from parley.operators.ranking import top_k
from parley.operators.quantiles import grouped_quantiles
from parley.operators.stats import S, bucket_index, bucketize, r6, summary_stats
from parley.plans.base import Context, report

# Bucket edges (label, lo, hi), half-open.
BLOCK_LEN_BUCKETS = [("<100", 0, 100), ("100–500", 100, 500), ("500–2 K", 500, 2000), ("2–10 K", 2000, 10000),
                     ("10 K+", 10000, float("inf"))]
BLOCKS_PER_CONVO_BUCKETS = [("1", 1, 2), ("2–5", 2, 6), ("6–20", 6, 21), ("21–100", 21, 101), ("100+", 101, float("inf"))]
CODE_SHARE_BUCKETS = [("0%", 0.0, 1e-9), (">0–10%", 1e-9, 0.10), ("10–30%", 0.10, 0.30), ("30–60%", 0.30, 0.60),
                      ("60%+", 0.60, 1.01)]
# Language tag aliases (after trim, lower case, first word).
LANG_ALIAS = {
    "ts": "typescript",
    "js": "javascript",
    "py": "python",
    "sh": "bash",
    "shell": "bash",
    "zsh": "bash",
    "cpp": "c++",
    "c#": "csharp",
    "cs": "csharp",
    "yml": "yaml",
    "md": "markdown",
    "txt": "(plain)",
    "plaintext": "(plain)",
    "text": "(plain)",
}
# Labels are English renderings of the source's labels; edges, patterns and members are the source's values.
EMPTY_LANG = "(empty)"
TOP_LANGUAGES = 20
SENDERS = ["human", "assistant"]

M = "m10"


def normalize_lang(raw) -> F.Column:
    """Trim, lower-case, keep the first word, map aliases; empty or NULL -> EMPTY_LANG."""
    s = F.lower(T.strip_ws(raw))
    first = F.get(F.split(s, r"(?U)\s+"), 0)
    return F.when(raw.isNull() | (s == ""), F.lit(EMPTY_LANG)).otherwise(map_alias(first, LANG_ALIAS))


def _blocks(ctx: Context):
    return ctx.stats.code_block


@report(M, "m10_totals")
def totals(ctx: Context):
    return _blocks(ctx).agg(
        F.count(F.lit(1)).alias("blocks"), F.countDistinct("message_uuid").alias("messages_with_blocks"),
        F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("chars"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))


@report(M, "m10_by_sender")
def by_sender(ctx: Context):
    b = (_blocks(ctx).where(F.col("sender").isin(*SENDERS)).groupBy("sender")
         .agg(F.count(F.lit(1)).alias("blocks"), F.sum("tokens").alias("tokens"),
              F.countDistinct("message_uuid").alias("messages_with_blocks")))
    t = (ctx.stats.message.where(F.col("sender").isin(*SENDERS) & (F.col("chars_text") > 0))
         .groupBy("sender").agg(F.count(F.lit(1)).alias("messages_with_text")))
    grid = cells(ctx.spark.range(1).select(), {"sender": axis(SENDERS)})
    d = zero_fill(zero_fill(grid, b, ["sender"], ["blocks", "tokens", "messages_with_blocks"]),
                  t, ["sender"], ["messages_with_text"])
    return d.select("*", F.when(F.col("messages_with_text") == 0, F.lit(None).cast("double"))
                    .otherwise(r6(100.0 * F.col("messages_with_blocks") / F.col("messages_with_text")))
                    .alias("pct_messages_with_blocks"))


@report(M, "m10_block_len")
def block_len(ctx: Context):
    return summary_stats(_blocks(ctx), [S("chars", F.col("chars") > 0)], ctx.cfg)


@report(M, "m10_block_len_buckets")
def block_len_buckets(ctx: Context):
    # bucket pct uses every block (zero-length ones included) as the denominator
    return bucketize(_blocks(ctx), [S("chars", F.col("chars") > 0, total_cond=F.lit(True))], BLOCK_LEN_BUCKETS)


@report(M, "m10_languages")
def languages(ctx: Context):
    # raw tags are counted first, their names normalised once each; the totals come from the counts
    raw = _blocks(ctx).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    g = raw.groupBy(normalize_lang(F.col("language")).alias("language")).agg(
        F.sum("n").alias("blocks"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("tokens"))
    tot = g.agg(F.struct(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n"),
                         F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))).scalar()
    nb, nt = tot["n"], tot["t"]
    return top_k(g, TOP_LANGUAGES, [F.desc("blocks"), F.asc("language")]).select(
        "language", "blocks", "tokens",
        F.when(nb == 0, 0.0).otherwise(r6(100.0 * F.col("blocks") / nb)).alias("pct_blocks"),
        F.when(nt == 0, 0.0).otherwise(r6(100.0 * F.col("tokens") / nt)).alias("pct_tokens"))


def _per_convo(ctx: Context):
    return _blocks(ctx).groupBy("conversation_uuid").agg(F.count(F.lit(1)).alias("blocks"))


@report(M, "m10_per_convo")
def per_convo(ctx: Context):
    return summary_stats(_per_convo(ctx), [S("blocks")], ctx.cfg)


@report(M, "m10_per_convo_buckets")
def per_convo_buckets(ctx: Context):
    return bucketize(_per_convo(ctx), [S("blocks")], BLOCKS_PER_CONVO_BUCKETS)


@report(M, "m10_code_share")
def code_share(ctx: Context):
    a = (ctx.stats.message.where(F.col("sender") == "assistant").groupBy("conversation_uuid")
         .agg(F.sum("tokens_code").alias("code"), F.sum("tokens_text").alias("text"))
         .where(F.col("text") > 0)
         .join(ctx.stats.conversation.select("conversation_uuid", "message_count"), "conversation_uuid"))
    a = a.select("message_count", bucket_index(F.col("code") / F.col("text"), CODE_SHARE_BUCKETS).alias("b"))
    q = grouped_quantiles(a.where(F.col("b").isNotNull()), ["b"], F.col("message_count"), (0.5, 0.95), ctx.cfg, few_groups=True)
    g = a.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(g.agg(F.sum("n").alias("t")).scalar(), F.lit(0))  # all, also outside every bucket
    names = F.inline(F.array(*[F.struct(F.lit(j).alias("b"), F.lit(label).alias("bucket"))
                               for j, (label, _, _) in enumerate(CODE_SHARE_BUCKETS)]))
    n = F.coalesce(F.col("n"), F.lit(0))
    return ctx.spark.range(1).select(names).join(g, "b", "left").join(q, "b", "left").select(
        F.col("b").alias("bucket_index"), "bucket", n.cast("long").alias("n"),
        F.when(total == 0, 0.0).otherwise(r6(100.0 * n / total)).alias("pct"),
        F.coalesce(F.col("p50").cast("long"), F.lit(0).cast("long")).alias("message_count_p50"),
        F.coalesce(F.col("p95").cast("long"), F.lit(0).cast("long")).alias("message_count_p95"))


@report(M, "m10_inline")
def inline(ctx: Context):
    """Single-backtick spans per sender (the span pattern uses lookbehind, in the JVM regex)."""
    m = ctx.stats.message.where(F.col("sender").isin(*SENDERS))
    g = m.groupBy("sender").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("inline_code_count") > 0).alias("messages_with_inline"),
        F.coalesce(F.sum("inline_code_count"), F.lit(0)).cast("long").alias("inline_spans"))
    return g.select("sender", "messages", "messages_with_inline",
                    r6(100.0 * F.col("messages_with_inline") / F.greatest(F.col("messages"), F.lit(1))).alias("pct"),
                    "inline_spans")
