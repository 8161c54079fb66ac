"""m04 activity rhythm: hour x weekday heatmaps, weekly / monthly / daily series, peaks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import time as TM
from parley.operators.grid import cells, seq, zero_fill
from parley.operators.stats import r6
from parley.plans.base import Context, report

M = "m04"


def _msg(ctx: Context):
    return ctx.stats.message.select(TM.hour("created_local").alias("hour"), TM.isodow("created_local").alias("dow"),
                                    "created_local")


def _conv(ctx: Context):
    c = ctx.stats.conversation.where(F.col("message_count") > 0)
    return c.select(TM.hour("created_local").alias("hour"), TM.isodow("created_local").alias("dow"), "created_local")


def _heat(ctx: Context, df):
    counts = df.groupBy("dow", "hour").agg(F.count(F.lit(1)).alias("n"))
    grid = cells(ctx.spark.range(1).select(), {"dow": seq(1, 7), "hour": seq(0, 23)})
    return zero_fill(grid, counts, ["dow", "hour"], ["n"])


@report(M, "m04_heatmap")
def heatmap(ctx: Context):
    return _heat(ctx, _msg(ctx))


@report(M, "m04_weekly")
def weekly(ctx: Context):
    return _msg(ctx).groupBy(TM.week_start("created_local").alias("week")).agg(F.count(F.lit(1)).alias("n"))


@report(M, "m04_monthly")
def monthly(ctx: Context):
    return _msg(ctx).groupBy(TM.month("created_local").alias("month")).agg(F.count(F.lit(1)).alias("total"))


def _hours(ctx: Context, df, name: str):
    counts = df.groupBy("hour").agg(F.count(F.lit(1)).alias(name))
    return zero_fill(cells(ctx.spark.range(1).select(), {"hour": seq(0, 23)}), counts, ["hour"], [name])


@report(M, "m04_new_convo_hour")
def new_convo_hour(ctx: Context):
    h = _hours(ctx, _conv(ctx), "n")
    total = F.sum("n").over(Window.partitionBy())  # over the 24-row report frame
    return h.select("hour", "n", F.when(total == 0, 0.0).otherwise(r6(100.0 * F.col("n") / total)).alias("pct"))


@report(M, "m04_new_convo_heatmap")
def new_convo_heatmap(ctx: Context):
    return _heat(ctx, _conv(ctx))


@report(M, "m04_daily_new")
def daily_new(ctx: Context):
    return _conv(ctx).groupBy(TM.day("created_local").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@report(M, "m04_peaks")
def peaks(ctx: Context):
    """Peak hour / weekday (first maximum: lowest index on ties), totals, weekend share: the
    hour and weekday sums of the 168-cell heatmap in one union, folded by one aggregation."""
    heat = heatmap(ctx)
    sums = (heat.groupBy("hour").agg(F.sum("n").alias("n")).select(F.lit("h").alias("axis"), F.col("hour").alias("i"), "n")
            .unionByName(heat.groupBy("dow").agg(F.sum("n").alias("n"))
                         .select(F.lit("d").alias("axis"), F.col("dow").alias("i"), "n")))
    is_h, is_d = F.col("axis") == "h", F.col("axis") == "d"
    best = lambda cond: F.max(F.when(cond, F.struct(F.col("n"), (-F.col("i")).alias("neg"))))
    a = sums.agg(F.sum(F.when(is_h, F.col("n"))).alias("total"),
                 F.sum(F.when(is_d & (F.col("i") >= 6), F.col("n"))).alias("weekend"),
                 best(is_h).alias("ph"), best(is_d).alias("pd"))
    return a.select(
        F.col("total").cast("long").alias("total_messages"),
        (-F.col("ph.neg")).cast("int").alias("peak_hour"), F.col("ph.n").cast("long").alias("peak_hour_messages"),
        (-F.col("pd.neg")).cast("int").alias("peak_dow"), F.col("pd.n").cast("long").alias("peak_dow_messages"),
        r6(100.0 * F.coalesce(F.col("weekend"), F.lit(0)) / F.greatest(F.col("total"), F.lit(1))).alias("weekend_pct"),
    )


@report(M, "m04_hourly_pct")
def hourly_pct(ctx: Context):
    hm = _hours(ctx, _msg(ctx), "messages")
    hc = _hours(ctx, _conv(ctx), "conversations")
    j = hm.join(hc, "hour")
    everything = Window.partitionBy()  # over the 24-row report frame
    tm, tc = F.sum("messages").over(everything), F.sum("conversations").over(everything)
    return j.select(
        "hour",
        F.when(tm == 0, 0.0).otherwise(r6(100.0 * F.col("messages") / tm)).alias("messages_pct"),
        F.when(tc == 0, 0.0).otherwise(r6(100.0 * F.col("conversations") / tc)).alias("conversations_pct"),
    )
