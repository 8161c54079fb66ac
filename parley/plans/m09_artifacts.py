"""m09 artifact profile: parsed `artifacts` tool inputs — types, commands, languages, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.categorize import map_alias

from parley.operators.ranking import top_k
from parley.operators.stats import S, bucketize, cohort_compare, r6, summary_stats
from parley.plans.base import Context, report

# Bucket edges (label, lo, hi), half-open.
PER_CONVO_BUCKETS = [("1", 1, 2), ("2–5", 2, 6), ("6–15", 6, 16), ("16–50", 16, 51), ("51+", 51, float("inf"))]
CONTENT_LEN_BUCKETS = [("<500", 0, 500), ("500–2 K", 500, 2000), ("2–10 K", 2000, 10000),
                       ("10–50 K", 10000, 50000), ("50 K+", 50000, float("inf"))]
# Raw artifact type -> readable label (others pass through).
TYPE_LABELS = {
    "text/markdown": "markdown",
    "image/svg+xml": "svg",
    "application/vnd.ant.svg": "svg",
    "application/vnd.ant.code": "code",
    "application/vnd.ant.react": "react",
    "text/html": "html",
    "application/vnd.ant.mermaid": "mermaid",
    "text/plain": "plain",
}
# Labels are English renderings of the source's labels; edges, patterns and members are the source's values.
UNTYPED = "(untyped)"
NO_COMMAND = "(none)"
MAIN_COMMANDS = ["create", "update", "rewrite"]
ARTIFACT_TOOL = "artifacts"
TOP_LANGUAGES = 10

M = "m09"


def parsed(ctx: Context):
    """m09.1: one row per artifact call whose input parses as a JSON object (others skipped);
    parsed once per dataset and shared by every m09 report."""
    return ctx.derived("artifacts", lambda: _parse(ctx))


def _parse(ctx: Context):
    c = ctx.tables.tool_calls.where((F.col("name") == ARTIFACT_TOOL) & F.col("input").isNotNull())
    v = F.try_parse_json("input")
    p = c.select("conversation_uuid", v.alias("v")).where(
        F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))

    def get(path):
        return F.try_variant_get("v", path, "string")

    typ, cmd, lang, content = get("$.type"), get("$.command"), get("$.language"), get("$.content")
    nonempty = lambda x: x.isNotNull() & (x != "")
    label = F.when(nonempty(typ), map_alias(typ, TYPE_LABELS)).otherwise(F.lit(UNTYPED))
    return p.select(
        "conversation_uuid",
        label.alias("type_label"),
        F.when(nonempty(cmd), cmd).otherwise(F.lit(NO_COMMAND)).alias("command"),
        F.when(nonempty(lang), lang).alias("language"),
        F.when(nonempty(content), F.length(content)).cast("long").alias("content_length"),
    )


@report(M, "m09_parse", needs=("tool_calls",), row_level=True)
def parse(ctx: Context):
    return parsed(ctx)


def _share(df, key: str, ctx: Context):
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(g.agg(F.sum("n")).scalar(), F.lit(0))
    return g.select(key, "n", F.when(total == 0, 0.0).otherwise(r6(100.0 * F.col("n") / total)).alias("pct"))


@report(M, "m09_types", needs=("tool_calls",))
def types(ctx: Context):
    return _share(parsed(ctx), "type_label", ctx)


@report(M, "m09_commands", needs=("tool_calls",))
def commands(ctx: Context):
    return _share(parsed(ctx), "command", ctx)


@report(M, "m09_type_command", needs=("tool_calls",))
def type_command(ctx: Context):
    p = parsed(ctx)
    cols = [F.count_if(F.col("command") == c).alias(c) for c in MAIN_COMMANDS]
    g = p.groupBy("type_label").agg(*cols)
    return g.select("type_label", *MAIN_COMMANDS, sum((F.col(c) for c in MAIN_COMMANDS), F.lit(0)).alias("total"))


@report(M, "m09_languages", needs=("tool_calls",))
def languages(ctx: Context):
    code = parsed(ctx).where((F.col("type_label") == "code") & F.col("language").isNotNull())
    g = code.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(g.agg(F.sum("n")).scalar(), F.lit(0))
    return top_k(g, TOP_LANGUAGES, [F.desc("n"), F.asc("language")]).select(
        "language", "n", F.when(total == 0, 0.0).otherwise(r6(100.0 * F.col("n") / total)).alias("pct"))


def _content(ctx: Context):
    return parsed(ctx).where(F.col("content_length").isNotNull())


@report(M, "m09_content_len", needs=("tool_calls",))
def content_len(ctx: Context):
    return summary_stats(_content(ctx), [S("content_length")], ctx.cfg)


@report(M, "m09_content_len_buckets", needs=("tool_calls",))
def content_len_buckets(ctx: Context):
    return bucketize(_content(ctx), [S("content_length")], CONTENT_LEN_BUCKETS)


def _per_convo(ctx: Context):
    return parsed(ctx).groupBy("conversation_uuid").agg(
        F.count(F.lit(1)).alias("artifact_calls"),
        F.count_if(F.col("command").isin("update", "rewrite")).alias("iterations"))


@report(M, "m09_per_convo", needs=("tool_calls",))
def per_convo(ctx: Context):
    return summary_stats(_per_convo(ctx), [S("artifact_calls")], ctx.cfg)


@report(M, "m09_per_convo_buckets", needs=("tool_calls",))
def per_convo_buckets(ctx: Context):
    return bucketize(_per_convo(ctx), [S("artifact_calls")], PER_CONVO_BUCKETS)


@report(M, "m09_iteration", needs=("tool_calls",))
def iteration(ctx: Context):
    a = parsed(ctx).agg(*[F.count_if(F.col("command") == c).alias(c) for c in MAIN_COMMANDS])
    return a.select(*MAIN_COMMANDS, F.when(F.col("create") == 0, 0.0)
                    .otherwise(r6((F.col("update") + F.col("rewrite")) / F.col("create"))).alias("iteration_ratio"))


@report(M, "m09_iteration_per_convo", needs=("tool_calls",))
def iteration_per_convo(ctx: Context):
    return summary_stats(_per_convo(ctx), [S("iterations", F.col("iterations") > 0)], ctx.cfg)


@report(M, "m09_compare", needs=("tool_calls",))
def compare(ctx: Context):
    """With vs without an artifact call (a call named artifacts with an input, parsed or not)."""
    art = (ctx.tables.tool_calls.where((F.col("name") == ARTIFACT_TOOL) & F.col("input").isNotNull())
           .select("conversation_uuid").distinct().select("conversation_uuid", F.lit(True).alias("has_artifact")))
    c = ctx.stats.conversation.where(F.col("message_count") > 0).join(art, "conversation_uuid", "left")
    return cohort_compare(c, F.coalesce(F.col("has_artifact"), F.lit(False)),
                          {"message_count": F.col("message_count"),
                           "tokens": F.col("tokens_human") + F.col("tokens_assistant")},
                          labels=("with_artifact", "without_artifact"), cfg=ctx.cfg)



