"""m13 interventions: prompt edits (human forks), retries (assistant forks), in-place edits, multi-root.

Naming follows the acting party: a *human fork* is a fork point whose parent is an assistant
message (the user rewrote the prompt under it); an *assistant fork* has a human parent (retry).
First / last siblings come from min/max-over-struct aggregations per parent (partial
aggregation; a parent with very many children never lands in one window task).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.config import SENTINEL_ROOT
from parley.operators.grid import axis, cells
from parley.operators.quantiles import grouped_quantiles
from parley.operators.ranking import order_key, top_k
from parley.operators.stats import S, bucketize, cohort_compare, r6, summary_stats
from parley.plans.base import Context, report

# Fork points per conversation, closed [lo, hi] integer buckets.
FORK_PER_CONVO_BUCKETS = [("1", 1, 1), ("2-5", 2, 5), ("6-20", 6, 20), ("20+", 21, float("inf"))]
# In-place edit delay in seconds, half-open.
# Labels are English renderings of the source's labels; edges, patterns and members are the source's values.
INPLACE_DELTA_BUCKETS = [("1–5m", 60, 300), ("5–60m", 300, 3600), ("1–24h", 3600, 86400),
                         ("1–7d", 86400, 604800), (">7d", 604800, float("inf"))]
# kind -> sender of the fork *parent*
KINDS = {"human_fork": "assistant", "assistant_fork": "human"}
# kind -> sender of the children counted in the top lists
CHILD_SENDER = {"human_fork": "human", "assistant_fork": "assistant"}
TOP_N = 3
TOP_HEAVY = 10
COMBO_FLAGS = [("human-fork", "human_fork_count > 0"), ("asst-fork", "assistant_fork_count > 0"),
               ("in-place", "inplace_edit_count > 0"), ("multi-root", "root_count > 1")]
NO_FLAGS = "(none)"

M = "m13"


def _sm(ctx: Context):
    return ctx.stats.message


def _sc(ctx: Context):
    return ctx.stats.conversation


@report(M, "m13_totals")
def totals(ctx: Context):
    fp, snd = F.col("fork_parent_flag"), F.col("sender")
    m = _sm(ctx).agg(F.struct(F.count_if(fp & (snd == "assistant")).alias("human_fork_points"),
                              F.count_if(fp & (snd == "human")).alias("assistant_fork_points"),
                              F.count_if("inplace_edit_flag").alias("inplace_edits"))).scalar()
    c = _sc(ctx).agg(F.count_if(F.col("human_fork_count") > 0).alias("human_fork_conversations"),
                     F.count_if(F.col("assistant_fork_count") > 0).alias("assistant_fork_conversations"),
                     F.count_if(F.col("inplace_edit_count") > 0).alias("inplace_conversations"),
                     F.count_if(F.col("root_count") > 1).alias("multi_root_conversations"),
                     F.count_if(F.col("message_count") > 0).alias("nonempty_conversations"))
    return c.select(*[m[x].alias(x) for x in ("human_fork_points", "assistant_fork_points", "inplace_edits")],
                    *c.columns)


@report(M, "m13_extra_children")
def extra_children(ctx: Context):
    fp = _sm(ctx).where(F.col("fork_parent_flag"))
    return fp.agg(*[F.coalesce(F.sum(F.when(F.col("sender") == s, F.col("child_count") - 1)), F.lit(0))
                    .cast("long").alias(f"extra_children_{k}") for k, s in KINDS.items()])


def _fork_series():
    h, a = F.col("human_fork_count"), F.col("assistant_fork_count")
    return [S(h, h > 0, kind="human_fork"), S(a, a > 0, kind="assistant_fork")]


@report(M, "m13_fork_per_convo")
def fork_per_convo(ctx: Context):
    return summary_stats(_sc(ctx), _fork_series(), ctx.cfg)


@report(M, "m13_fork_per_convo_buckets")
def fork_per_convo_buckets(ctx: Context):
    return bucketize(_sc(ctx), _fork_series(), FORK_PER_CONVO_BUCKETS, closed=True)


def _fork_children(ctx: Context):
    """Children of fork parents with the fork kind (from the parent's sender), in one pass;
    built once per dataset (two reports read it)."""
    return ctx.derived("fork_children", lambda: _build_fork_children(ctx))


def _build_fork_children(ctx: Context):
    kind = F.when(F.col("sender") == KINDS["human_fork"], F.lit("human_fork")).otherwise(F.lit("assistant_fork"))
    parents = _sm(ctx).where(F.col("fork_parent_flag") & F.col("sender").isin(*KINDS.values())).select(
        F.col("message_uuid").alias("parent_message_uuid"), kind.alias("kind"))
    # parents are unique keys; a parent with very many children is a skewed key on the message
    # side only, which AQE's skew join splits
    return _sm(ctx).join(parents, "parent_message_uuid").select(
        "kind", "message_uuid", "parent_message_uuid", "created_at", "chars_text",
        (F.col("child_count") > 0).alias("cont"))


def _per_kind(ctx: Context, agg_df, cols: list[str]):
    """Both kinds always present (zeros / NULLs for a kind without fork parents)."""
    grid = cells(ctx.spark.range(1).select(), {"kind": axis(list(KINDS))})
    return grid.join(agg_df, "kind", "left").select("kind", *cols)


@report(M, "m13_branch_continued")
def branch_continued(ctx: Context):
    # the ends of every parent's children as min / max structs: partial aggregation, no join back
    first, last = order_key("created_at", "message_uuid"), order_key("created_at", "message_uuid", desc=True)
    per = _fork_children(ctx).groupBy("kind", "parent_message_uuid").agg(
        F.min(F.struct(first.alias("k"), "cont"))["cont"].cast("int").alias("f"),
        F.max(F.struct(last.alias("k"), "cont"))["cont"].cast("int").alias("l"),
        F.count_if("cont").alias("c"), F.count(F.lit(1)).alias("n"))
    ends = F.col("f") + F.when(F.col("n") > 1, F.col("l")).otherwise(0)  # an only child is both
    a = per.groupBy("kind").agg(
        F.sum("f").alias("first_continued"), F.sum("l").alias("last_continued"),
        F.sum(F.col("c") - ends).alias("middle_continued"), F.sum("c").alias("continued"),
        F.sum("n").alias("children"))
    cols = ["first_continued", "last_continued", "middle_continued", "continued", "children"]
    return _per_kind(ctx, a, [F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in cols])


@report(M, "m13_len_delta")
def len_delta(ctx: Context):
    key = order_key("created_at", "message_uuid")
    keyd = order_key("created_at", "message_uuid", desc=True)
    per = _fork_children(ctx).groupBy("kind", "parent_message_uuid").agg(
        F.min(F.struct(key.alias("k"), F.col("chars_text").alias("v")))["v"].alias("first_chars"),
        F.max(F.struct(keyd.alias("k"), F.col("chars_text").alias("v")))["v"].alias("last_chars"))
    fc, lc = F.col("first_chars").cast("double"), F.col("last_chars").cast("double")
    a = per.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(lc > fc).alias("lengthened"), F.count_if(lc < fc).alias("shortened"),
        F.count_if(lc == fc).alias("unchanged"))
    for end, v in (("first", fc), ("last", lc)):
        q = grouped_quantiles(per, ["kind"], v, (0.5, 0.95), ctx.cfg, few_groups=True)
        a = a.join(q.select("kind", *[r6(F.col(p)).alias(f"{end}_{p}") for p in ("p50", "p95")]), "kind", "left")
    counts = ["n", "lengthened", "shortened", "unchanged"]
    return _per_kind(ctx, a, [F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) if x in counts else F.col(x)
                              for x in ["n", "first_p50", "last_p50", "first_p95", "last_p95", "lengthened",
                                        "shortened", "unchanged"]])


def _inplace(ctx: Context):
    return _sm(ctx).where(F.col("inplace_edit_flag") & F.col("edit_delta_seconds").isNotNull())


@report(M, "m13_inplace_delta")
def inplace_delta(ctx: Context):
    return bucketize(_inplace(ctx), [S("edit_delta_seconds")], INPLACE_DELTA_BUCKETS)


@report(M, "m13_inplace_compare")
def inplace_compare(ctx: Context):
    a = _sm(ctx).where((F.col("sender") == "assistant") & (F.col("chars_text") > 0))
    return cohort_compare(a, F.col("inplace_edit_flag"), {"chars_text": F.col("chars_text")},
                          labels=("inplace_edit", "no_edit"), cfg=ctx.cfg)


def _multi_root(ctx: Context):
    return _sc(ctx).where(F.col("root_count") > 1)


@report(M, "m13_multi_root")
def multi_root(ctx: Context):
    mr = _multi_root(ctx)
    g = mr.groupBy("root_count").agg(F.count(F.lit(1)).alias("n"))
    p50s = [grouped_quantiles(mr, ["root_count"], F.col(c), (0.5,), ctx.cfg).select("root_count", r6(F.col("p50")).alias(out))
            for c, out in (("message_count", "message_count_p50"), ("lifetime_seconds", "lifetime_p50"))]
    for p in p50s:
        g = g.join(p, "root_count", "left")
    return g.select("root_count", "n", "message_count_p50", "lifetime_p50")


@report(M, "m13_multi_root_list", row_level=True)
def multi_root_list(ctx: Context):
    return _multi_root(ctx).select("conversation_uuid", "name", "root_count", "message_count",
                                   r6(F.col("lifetime_seconds")).alias("lifetime_seconds"))


@report(M, "m13_combinations")
def combinations(ctx: Context):
    c = _sc(ctx).where(F.col("message_count") > 0)
    flags = [F.expr(cond).alias(f"f{i}") for i, (_, cond) in enumerate(COMBO_FLAGS)]
    g = c.select(*flags).groupBy(*[f"f{i}" for i in range(len(COMBO_FLAGS))]).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(g.agg(F.sum("n")).scalar(), F.lit(0))
    tags = F.array_compact(F.array(*[F.when(F.col(f"f{i}"), F.lit(lbl)) for i, (lbl, _) in enumerate(COMBO_FLAGS)]))
    label = F.when(F.size(tags) == 0, F.lit(NO_FLAGS)).otherwise(F.array_join(tags, " + "))
    return g.select(*[F.col(f"f{i}").alias(lbl.replace("-", "_")) for i, (lbl, _) in enumerate(COMBO_FLAGS)],
                    label.alias("label"), "n",
                    r6(100.0 * F.col("n") / F.greatest(total, F.lit(1))).alias("pct"))


def _top_children(ctx: Context, kind: str):
    """m13.10 / m13.11: per conversation, Σ(children-1), fork points, max children for parents
    with more than one child of the given sender. Groups by conversation id by default;
    cfg.merge_by_name groups by (name, message_count) as the source does."""
    m = _sm(ctx)
    pc = (m.where((F.col("sender") == CHILD_SENDER[kind]) & F.col("parent_message_uuid").isNotNull()
                  & (F.col("parent_message_uuid") != SENTINEL_ROOT))
          .groupBy("parent_message_uuid", "conversation_uuid").agg(F.count(F.lit(1)).alias("c"))
          .where(F.col("c") > 1))
    j = pc.join(_sc(ctx).select("conversation_uuid", "name", "message_count"), "conversation_uuid")
    keys = ["name", "message_count"] if ctx.cfg.merge_by_name else ["conversation_uuid", "name", "message_count"]
    g = j.groupBy(*keys).agg(F.sum(F.col("c") - 1).alias("count"), F.count(F.lit(1)).alias("fork_points"),
                             F.max("c").alias("max_children"))
    if ctx.cfg.merge_by_name:
        g = g.withColumn("conversation_uuid", F.lit(None).cast("string"))
    return top_k(g, TOP_N, [F.desc("count"), F.asc("name"), F.asc("conversation_uuid")]).select(
        "conversation_uuid", "name", "message_count", "count", "fork_points", "max_children")


@report(M, "m13_top_edits")
def top_edits(ctx: Context):
    return _top_children(ctx, "human_fork")


@report(M, "m13_top_retries")
def top_retries(ctx: Context):
    return _top_children(ctx, "assistant_fork")


@report(M, "m13_top_inplace")
def top_inplace(ctx: Context):
    c = _sc(ctx).where(F.col("inplace_edit_count") > 0)
    return top_k(c, TOP_N, [F.desc("inplace_edit_count"), F.asc("conversation_uuid")]).select(
        "conversation_uuid", "name", "inplace_edit_count", "message_count")


@report(M, "m13_top_forks")
def top_forks(ctx: Context):
    c = _sc(ctx).withColumn("total_forks", F.col("human_fork_count") + F.col("assistant_fork_count"))
    return top_k(c.where(F.col("total_forks") > 0), TOP_N,
                 [F.desc("total_forks"), F.desc("human_fork_count"), F.asc("conversation_uuid")]).select(
        "conversation_uuid", "name", "human_fork_count", "assistant_fork_count", "total_forks", "message_count")


@report(M, "m13_fork_list", row_level=True)
def fork_list(ctx: Context):
    fp = _sm(ctx).where(F.col("fork_parent_flag") & F.col("sender").isin(*KINDS.values()))
    kind = F.when(F.col("sender") == "assistant", F.lit("human_fork")).otherwise(F.lit("assistant_fork"))
    return fp.select(kind.alias("kind"), "conversation_uuid", F.col("message_uuid").alias("parent_message_uuid"),
                     F.col("sender").alias("parent_sender"), F.col("chars_text").alias("parent_chars"), "child_count")


@report(M, "m13_inplace_list", row_level=True)
def inplace_list(ctx: Context):
    return _sm(ctx).where("inplace_edit_flag").select("conversation_uuid", "message_uuid", "sender", "chars_text",
                                                      r6(F.col("edit_delta_seconds")).alias("edit_delta_seconds"))


@report(M, "m13_heavy")
def heavy(ctx: Context):
    c = _sc(ctx).where(F.col("message_count") > 0)
    score = (F.col("human_fork_count") + F.col("assistant_fork_count") + F.col("inplace_edit_count")
             + F.when(F.col("root_count") > 1, F.col("root_count")).otherwise(0))
    return top_k(c.withColumn("score", score), TOP_HEAVY, [F.desc("score"), F.asc("conversation_uuid")]).select(
        "conversation_uuid", "name", "human_fork_count", "assistant_fork_count", "inplace_edit_count", "root_count",
        "message_count", "score")
