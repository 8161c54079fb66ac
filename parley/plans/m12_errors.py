"""m12 tool errors: rates per tool, error categories, normalised samples, behaviour after an error."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import text as T
from parley.functions.categorize import regex_categorize
from parley.operators.grid import axis, cells, names_array, zero_fill
from parley.operators.ordered import first_then_after
from parley.operators.ranking import top_k, top_k_per_group
from parley.operators.stats import cohort_compare, r6
from parley.plans.base import Context, report

MIN_CALLS_FOR_RATE = 20
TOP_RATE_TOOLS = 20
TOP_ERROR_TOOLS = 10
SAMPLES_PER_CATEGORY = 10
NORMALIZED_LIMIT = 200
# Ordered error categories; the first category with any matching pattern wins.
CATEGORY_PATTERNS = [
    ("NOT_FOUND", [r"not found", r"\b404\b", r"does not exist", r"no such"]),
    ("PERMISSIONS", [r"permission", r"forbidden", r"\b403\b", r"blocked"]),
    ("TIMEOUT", [r"timeout", r"timed out", r"deadline"]),
    ("RATE_LIMIT", [r"rate.?limit", r"\b429\b", r"too many"]),
    ("ROBOTS", [r"robots", r"disallow"]),
    ("CLIENT_ERROR", [r"client_error", r"\b400\b", r"bad request", r"cannot be fetched"]),
    ("VALIDATION", [r"validation", r"invalid input", r"field required", r"schema"]),
    ("NO_RESULT", [r"no result received", r"empty response"]),
    ("SYNTAX", [r"syntax", r"parse error", r"malformed"]),
    ("FETCH_UNKNOWN", [r"unknown error", r"error while fetching"]),
]
OTHER = "OTHER"
# Masks applied in this order (paths before URLs, so a URL keeps its scheme).
UUID_RE = r"(?U)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
PATH_RE = r"/[A-Za-z0-9._/\-]+"
URL_RE = r"(?U)https?://\S+"
WS_RE = r"(?U)\s+"
POST_ORDER = ["retry_same_tool", "diff_tool", "no_tool", "ended_on_human", "no_followup"]

M = "m12"
NEEDS = ("tool_results",)


def categorize(text) -> F.Column:
    """P11 over the error text (case-insensitive via lower())."""
    return regex_categorize(text, [(c, [f"(?U){p}" for p in ps]) for c, ps in CATEGORY_PATTERNS], OTHER)


def normalize(text) -> F.Column:
    """m12.7: trim, mask uuids / paths / urls, collapse whitespace, first 200 characters."""
    t = T.strip_ws(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, UUID_RE, "<UUID>")
    t = F.regexp_replace(t, PATH_RE, "<PATH>")
    t = F.regexp_replace(t, URL_RE, "<URL>")
    t = F.regexp_replace(t, WS_RE, " ")
    return F.substring(t, 1, NORMALIZED_LIMIT)


def _results(ctx: Context):
    return ctx.tables.tool_results


@report(M, "m12_totals", needs=NEEDS)
def totals(ctx: Context):
    r = _results(ctx)
    e = F.col("is_error")
    a = r.agg(F.count(F.lit(1)).alias("results"), F.count_if(e).alias("errors"),
              F.countDistinct(F.when(e, F.col("conversation_uuid"))).alias("error_conversations"),
              F.countDistinct(F.when(e, F.col("message_uuid"))).alias("error_messages"))
    return a.select("results", "errors",
                    F.when(F.col("results") == 0, 0.0).otherwise(r6(100.0 * F.col("errors") / F.col("results")))
                    .alias("error_pct"), "error_conversations", "error_messages")


def _rates(ctx: Context):
    g = _results(ctx).groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"))
    return g.select("name", "calls", "errors",
                    F.when(F.col("calls") == 0, 0.0).otherwise(r6(100.0 * F.col("errors") / F.col("calls")))
                    .alias("error_pct"))


@report(M, "m12_tool_rates", needs=NEEDS, row_level=True)
def tool_rates(ctx: Context):
    return _rates(ctx)


@report(M, "m12_tool_rates_top", needs=NEEDS)
def tool_rates_top(ctx: Context):
    r = _rates(ctx).where(F.col("calls") >= MIN_CALLS_FOR_RATE)
    return top_k(r, TOP_RATE_TOOLS, [F.desc("error_pct"), F.asc_nulls_last("name")])


@report(M, "m12_highlight_tools", needs=NEEDS)
def highlight_tools(ctx: Context):
    """Rows: most_errors; highest_rate_by_count (the source's rule: first tool by error count
    with >= 20 calls, else the first tool); highest_rate (true maximum rate with >= 20 calls)."""
    r = _rates(ctx)
    by_err = [F.desc("errors"), F.asc_nulls_last("name")]
    most = top_k(r, 1, by_err).select(F.lit("most_errors").alias("kind"), "*")
    elig = r.where(F.col("calls") >= MIN_CALLS_FOR_RATE)
    # eligible first, then the same order: the first row is the rule's answer either way
    rule = top_k(r.withColumn("_e", F.col("calls") >= MIN_CALLS_FOR_RATE), 1,
                 [F.desc("_e")] + by_err).drop("_e").select(F.lit("highest_rate_by_count").alias("kind"), "*")
    best = top_k(elig, 1, [F.desc("error_pct"), F.desc("errors"), F.asc_nulls_last("name")]).select(
        F.lit("highest_rate").alias("kind"), "*")
    return most.unionByName(rule).unionByName(best)


def _error_rows(ctx: Context):
    """m12.4: one row per text element of an error result (empty / NULL content drops out)."""
    r = _results(ctx).where(F.col("is_error"))
    return r.select("name", "conversation_uuid", "message_uuid", F.explode("texts").alias("msg"))


@report(M, "m12_error_messages", needs=NEEDS, row_level=True)
def error_messages(ctx: Context):
    return _error_rows(ctx)


def _categorized(ctx: Context):
    """Error texts with category and normalised form: regexes run once per dataset, shared by
    the category, cross-tab, normalisation and sample reports."""
    return ctx.derived("error_texts", lambda: _error_rows(ctx).select(
        "name", "message_uuid", "msg", categorize(F.col("msg")).alias("category"),
        normalize(F.col("msg")).alias("normalized")))


@report(M, "m12_categories", needs=NEEDS)
def categories(ctx: Context):
    c = _categorized(ctx)
    g = c.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(g.agg(F.sum("n")).scalar(), F.lit(0))
    return g.select("category", "n", F.when(total == 0, 0.0).otherwise(r6(100.0 * F.col("n") / total)).alias("pct"))


@report(M, "m12_category_tool", needs=NEEDS)
def category_tool(ctx: Context):
    tools = top_k(_rates(ctx), TOP_ERROR_TOOLS, [F.desc("errors"), F.asc_nulls_last("name")]).where(
        F.col("name").isNotNull())
    c = _categorized(ctx)
    cats = c.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    counts = c.groupBy(F.col("name").alias("tool"), "category").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("n")).alias("c"), F.col("category").alias("k"))
    grid = cells(tools.select(F.col("name").alias("tool")), {"category": names_array(cats, "category", order)})
    d = zero_fill(grid, counts, ["tool", "category"], ["n"])
    return d.select("tool", "category", "n", F.sum("n").over(Window.partitionBy("tool")).alias("tool_total"))


@report(M, "m12_normalize", needs=NEEDS, row_level=True)
def normalized(ctx: Context):
    return _categorized(ctx).select("name", "message_uuid", "category", "normalized")


@report(M, "m12_samples", needs=NEEDS)
def samples(ctx: Context):
    g = normalized(ctx).groupBy("category", "normalized").agg(F.count(F.lit(1)).alias("n"))
    return top_k_per_group(g, ["category"], SAMPLES_PER_CATEGORY, [F.desc("n"), F.asc("normalized")],
                           target_rows=ctx.cfg.window_chunk_rows)


def _post_error(ctx: Context):
    """m12.9 in one ordering of the messages: every message gets the next human message after it and the
    next assistant message after that one. An error message then reads its follow-up from its own row: no self-joins."""
    results = _results(ctx).where(F.col("is_error"))
    # only conversations with an error are put in order
    touched = results.select("message_uuid").distinct().join(
        ctx.stats.message.select("message_uuid", "conversation_uuid"), "message_uuid").select("conversation_uuid").distinct()
    m = ctx.stats.message.select("conversation_uuid", "message_uuid", "position", "sender").join(
        touched, "conversation_uuid", "left_semi")
    at = F.struct(F.col("position").alias("pos"), F.col("message_uuid").alias("uuid"))
    h = first_then_after(m, "conversation_uuid", ["position", "message_uuid"], F.col("sender") == "human",
                         F.col("sender") == "assistant", at, ctx.cfg.window_chunk_rows)
    nxt = h.select("message_uuid", F.col("first_after.pos").alias("h_pos"), F.col("then_after.pos").alias("a_pos"),
                   F.col("then_after.uuid").alias("a_uuid"))
    errs = (results.groupBy("conversation_uuid", "message_uuid")
            .agg(F.collect_set("name").alias("err_tools")))
    e = errs.join(nxt, "message_uuid")  # error messages that exist in the message table
    tools = (ctx.tables.tool_calls.where(F.col("name").isNotNull()).withColumnRenamed("message_uuid", "a_uuid")
             .join(e.select("a_uuid").distinct(), "a_uuid", "left_semi").groupBy("a_uuid")
             .agg(F.collect_set("name").alias("a_tools")))
    e = e.join(tools, "a_uuid", "left")
    a_tools = F.coalesce(F.col("a_tools"), F.array().cast("array<string>"))
    outcome = (F.when(F.col("h_pos").isNull(), F.lit("no_followup"))
               .when(F.col("a_pos").isNull(), F.lit("ended_on_human"))
               .when(F.size(a_tools) == 0, F.lit("no_tool"))
               .when(F.arrays_overlap(a_tools, F.col("err_tools")), F.lit("retry_same_tool"))
               .otherwise(F.lit("diff_tool")))
    return e.select("conversation_uuid", "message_uuid", outcome.alias("outcome"))


@report(M, "m12_post_error", needs=NEEDS + ("tool_calls",))
def post_error(ctx: Context):
    p = _post_error(ctx)
    counts = p.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    grid = cells(ctx.spark.range(1).select(), {"outcome": axis(POST_ORDER)})
    d = zero_fill(grid, counts, ["outcome"], ["n"])
    total = F.coalesce(counts.agg(F.sum("n")).scalar(), F.lit(0))
    idx = (F.array_position(axis(POST_ORDER), F.col("outcome")) - 1).cast("int")
    return d.select(idx.alias("outcome_index"), "outcome", "n",
                    F.when(total == 0, F.lit(None).cast("double")).otherwise(r6(100.0 * F.col("n") / total))
                    .alias("pct"))


@report(M, "m12_compare", needs=NEEDS)
def compare(ctx: Context):
    ec = (_results(ctx).where(F.col("is_error")).select("conversation_uuid").distinct()
          .select("conversation_uuid", F.lit(True).alias("has_error")))
    c = ctx.stats.conversation.where(F.col("message_count") > 0).join(ec, "conversation_uuid", "left")
    return cohort_compare(c, F.coalesce(F.col("has_error"), F.lit(False)),
                          {"message_count": F.col("message_count"), "tool_calls": F.col("tool_calls_total"),
                           "lifetime_s": F.col("lifetime_seconds")},
                          labels=("with_errors", "without_errors"), cfg=ctx.cfg)
