"""m08 projects and knowledge docs: totals, docs per project, doc / prompt length, monthly."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import time as TM
from parley.operators.stats import S, bucketize, r6, summary_stats
from parley.plans.base import Context, report

# Bucket edges (label, lo, hi), half-open.
DOCS_PER_PROJECT_BUCKETS = [("0", 0, 1), ("1", 1, 2), ("2–5", 2, 6), ("6–15", 6, 16), ("16+", 16, float("inf"))]
DOC_LEN_BUCKETS = [("<1 K", 0, 1000), ("1–10 K", 1000, 10000), ("10–100 K", 10000, 100000),
                   ("100 K–1 M", 100000, 1000000), (">1 M", 1000000, float("inf"))]
# "none" holds empty / missing prompts; the other buckets hold positive lengths.
# Labels are English renderings of the source's labels; edges, patterns and members are the source's values.
PROMPT_LEN_BUCKETS = [("none", -1, 0), ("<200", 0, 200), ("200–1 K", 200, 1000), ("1–5 K", 1000, 5000),
                      ("5 K+", 5000, float("inf"))]

M = "m08"
NEEDS = ("projects", "docs")


@report(M, "m08_totals", needs=NEEDS)
def totals(ctx: Context):
    p = ctx.tables.projects
    return p.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_starter_project").alias("starter"),
        F.count_if("is_private").alias("private"),
        F.count_if(F.col("description").isNotNull() & (F.col("description") != "")).alias("with_description"),
        F.count_if(F.col("prompt_template").isNotNull() & (F.col("prompt_template") != "")).alias("with_prompt"),
    )


@report(M, "m08_docs", needs=NEEDS)
def docs(ctx: Context):
    return ctx.tables.docs.agg(F.count(F.lit(1)).alias("docs"),
                               F.countDistinct("project_uuid").alias("projects_with_docs"))


def _per_project(ctx: Context):
    d = ctx.tables.docs.groupBy("project_uuid").agg(F.count(F.lit(1)).alias("docs"))
    return (ctx.tables.projects.select("project_uuid").join(d, "project_uuid", "left")
            .select("project_uuid", F.coalesce("docs", F.lit(0)).alias("docs")))


@report(M, "m08_docs_per_project", needs=NEEDS)
def docs_per_project(ctx: Context):
    return summary_stats(_per_project(ctx), [S("docs")], ctx.cfg)


@report(M, "m08_docs_per_project_buckets", needs=NEEDS)
def docs_per_project_buckets(ctx: Context):
    return bucketize(_per_project(ctx), [S("docs")], DOCS_PER_PROJECT_BUCKETS)


def _doc_lens(ctx: Context):
    c = F.col("content_length")
    return ctx.tables.docs.where(c.isNotNull() & (c > 0))


@report(M, "m08_doc_len", needs=NEEDS)
def doc_len(ctx: Context):
    return summary_stats(_doc_lens(ctx), [S("content_length")], ctx.cfg)


@report(M, "m08_doc_len_buckets", needs=NEEDS)
def doc_len_buckets(ctx: Context):
    return bucketize(_doc_lens(ctx), [S("content_length")], DOC_LEN_BUCKETS)


def _prompt(ctx: Context):
    n = F.coalesce(F.length("prompt_template"), F.lit(0))
    return ctx.tables.projects.select(n.alias("prompt_len"))


@report(M, "m08_prompt_len", needs=NEEDS)
def prompt_len(ctx: Context):
    return summary_stats(_prompt(ctx), [S("prompt_len", F.col("prompt_len") > 0)], ctx.cfg)


@report(M, "m08_prompt_len_buckets", needs=NEEDS)
def prompt_len_buckets(ctx: Context):
    v = F.when(F.col("prompt_len") == 0, F.lit(-1)).otherwise(F.col("prompt_len"))
    return bucketize(_prompt(ctx), [S(v)], PROMPT_LEN_BUCKETS)


@report(M, "m08_monthly", needs=NEEDS)
def monthly(ctx: Context):
    p = ctx.tables.projects.where(F.col("created_at").isNotNull())
    g = p.groupBy(TM.month(TM.local("created_at", ctx.cfg.tz)).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(g.agg(F.sum("n")).scalar(), F.lit(0))
    return g.select("month", "n", F.when(total == 0, 0.0).otherwise(r6(100.0 * F.col("n") / total)).alias("pct"))
