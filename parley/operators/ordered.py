"""Order-dependent operators within a group (lag, row number, "min of the rows after"),
safe for hot groups.

`Window.partitionBy(group)` sends every row of a group to one task, so a conversation that
holds a third of all messages would be sorted and buffered by a single task. These helpers
first count rows per group (partial aggregation: a hot group costs one row per map task).
The rows of groups above `target_rows` are range-partitioned by group and the whole sort order
(so equal timestamps, clustered ones and NULLs are cut like any others) and written with the
number of their range as `_chunk`; the window runs per (group, chunk) and chunk boundaries are
stitched with per-chunk aggregates (one row per chunk). Ranges are cut from Spark's sample of the
keys, at half the target, so that a task stays near it. When no group is that large, the plan
is the plain per-group window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_TARGET_ROWS = 2_000_000

def add_chunk(df: DataFrame, group: str, order: list[str], target_rows: int) -> tuple[DataFrame, bool]:
    """Add `_chunk`: 0 for ordinary groups, contiguous ranges of `order` for hot ones (rows
    without a group are one more group). Returns (frame, any_hot_group)."""
    hot = (df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target_rows))
    n_hot = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()  # small aggregate job; decides the plan
    plain = df.withColumn("_chunk", F.lit(0).cast("long"))
    if n_hot[0] == 0:
        return plain, False
    same = F.col(group).eqNullSafe(F.col("_g"))
    ranges = max(2, -(-2 * n_hot[1] // target_rows))
    rows = df.join(hot.select("_g"), same, "left_semi").repartitionByRange(ranges, F.col(group).asc_nulls_last(), *_order(order))
    # written, as two evaluations of a range partitioning may cut differently
    rows = rows.withColumn("_chunk", F.spark_partition_id().cast("long")).checkpoint()
    return plain.join(hot.select("_g"), same, "left_anti").unionByName(rows), True


def _order(order: list[Column | str]) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in order]


def _by_chunk(c: DataFrame, per: DataFrame, group: str) -> DataFrame:
    """Per-chunk facts (one row per group and chunk) put onto the rows; NULL groups match too."""
    per = per.withColumnsRenamed({group: "_pg", "_chunk": "_pc"})
    return c.join(per, F.col(group).eqNullSafe(F.col("_pg")) & (F.col("_chunk") == F.col("_pc")), "left").drop("_pg", "_pc")


def lag_within(df: DataFrame, group: str, order: list[str], cols: list[str],
               target_rows: int = DEFAULT_TARGET_ROWS) -> DataFrame:
    """Add prev_<col> = value of the previous row of the group in `order` (NULL for the first)."""
    c, hot = add_chunk(df, group, order, target_rows)
    w = Window.partitionBy(group, "_chunk").orderBy(*_order(order))
    c = c.select("*", *[F.lag(x).over(w).alias(f"prev_{x}") for x in cols],
                 F.row_number().over(w).alias("_rn"))
    if hot:
        # last row of every chunk, then the previous chunk's last row (one row per chunk)
        # max over (is_null, value) pairs = last row in ascending, NULLs-last order
        okey = F.struct(*[x for i, o in enumerate(order)
                          for x in (F.col(o).isNull().alias(f"_z{i}"), F.col(o).alias(f"_o{i}"))])
        last = c.groupBy(group, "_chunk").agg(F.max(F.struct(okey.alias("k"), *[F.col(x) for x in cols])).alias("_l"))
        wc = Window.partitionBy(group).orderBy("_chunk")
        last = last.select(group, "_chunk", F.lag("_l").over(wc).alias("_pl"))
        c = _by_chunk(c, last, group)
        for x in cols:
            c = c.withColumn(f"prev_{x}", F.when(F.col("_rn") == 1, F.col("_pl")[x]).otherwise(F.col(f"prev_{x}")))
        c = c.drop("_pl")
    return c.drop("_chunk", "_rn")


def row_number_within(df: DataFrame, group: str, order: list[str], name: str = "rn",
                      target_rows: int = DEFAULT_TARGET_ROWS) -> DataFrame:
    """Add the 1-based rank of each row inside its group by `order` (ties by later columns)."""
    c, hot = add_chunk(df, group, order, target_rows)
    w = Window.partitionBy(group, "_chunk").orderBy(*_order(order))
    c = c.withColumn(name, F.row_number().over(w).cast("long"))
    if hot:
        sizes = c.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_s"))
        wc = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select(group, "_chunk", F.coalesce(F.sum("_s").over(wc), F.lit(0)).alias("_off"))
        c = _by_chunk(c, sizes, group).withColumn(name, F.col(name) + F.col("_off")).drop("_off")
    return c.drop("_chunk")


def _after(group: str, order: list[Column | str]):
    """The rows strictly after each row. Read from the end, the frame only grows, so its aggregates are carried along;
    a frame up to `unboundedFollowing` would be gone through anew for every row."""
    back = [(F.col(c) if isinstance(c, str) else c).desc_nulls_first() for c in order]
    return Window.partitionBy(group, "_chunk").orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)


def _later_chunks(group: str):
    return Window.partitionBy(group).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)


def min_after(df: DataFrame, group: str, order: list[str], values: dict[str, Column],
              target_rows: int = DEFAULT_TARGET_ROWS) -> DataFrame:
    """Add, per name, min(value) over the rows strictly after each row in its group."""
    c, hot = add_chunk(df, group, order, target_rows)
    w = _after(group, order)
    c = c.select("*", *[F.min(v).over(w).alias(n) for n, v in values.items()])
    if hot:
        per = c.groupBy(group, "_chunk").agg(*[F.min(v).alias(f"_m_{n}") for n, v in values.items()])
        wc = _later_chunks(group)
        per = per.select(group, "_chunk", *[F.min(f"_m_{n}").over(wc).alias(f"_a_{n}") for n in values])
        c = _by_chunk(c, per, group)
        for n in values:
            c = c.withColumn(n, F.least(F.col(n), F.col(f"_a_{n}"))).drop(f"_a_{n}")
    return c.drop("_chunk")


def first_then_after(df: DataFrame, group: str, order: list[str], first: Column, then: Column, value: Column,
                     target_rows: int = DEFAULT_TARGET_ROWS) -> DataFrame:
    """Add `first_after`, `value` of the first row after each row of its group for which `first` holds, and `then_after`,
    `value` of the first row after that one for which `then` holds (NULL where there is none).

    One ordering for both: what follows a row is the triple (next first, next then after it, next then), which
    combines over adjoining ranges, so a hot group is cut and written once and its ranges are stitched by one scan
    over one row a range."""
    c, hot = add_chunk(df, group, order, target_rows)
    w = _after(group, order)
    c = c.select("*", F.last(F.when(then, value), ignorenulls=True).over(w).alias("_t"))
    c = c.select("*", F.last(F.when(first, F.struct(value.alias("v"), F.col("_t").alias("t"))), ignorenulls=True).over(w).alias("_f"))
    if hot:
        key = F.struct(*[x for i, o in enumerate(order) for x in (F.col(o).isNull().alias(f"_z{i}"), F.col(o).alias(f"_o{i}"))])
        per = c.groupBy(group, "_chunk").agg(
            F.min(F.when(first, F.struct(key.alias("k"), value.alias("v"), F.col("_t").alias("t")))).alias("_own"),
            F.min(F.when(then, F.struct(key.alias("k"), value.alias("v")))).alias("_then"))
        wc = _later_chunks(group)
        per = per.select(group, "_chunk", "_own", F.last(F.col("_then.v"), ignorenulls=True).over(wc).alias("_lt"))
        whole = F.when(F.col("_own").isNotNull(), F.struct(F.col("_own.v").alias("v"), F.coalesce("_own.t", "_lt").alias("t")))
        per = per.select(group, "_chunk", "_lt", F.last(whole, ignorenulls=True).over(wc).alias("_lf"))
        c = _by_chunk(c, per, group)
        c = c.withColumn("_f", F.when(F.col("_f").isNotNull(), F.struct(F.col("_f.v").alias("v"), F.coalesce("_f.t", "_lt").alias("t")))
                         .otherwise(F.col("_lf"))).drop("_lt", "_lf")
    return c.select("*", F.col("_f.v").alias("first_after"), F.col("_f.t").alias("then_after")).drop("_chunk", "_t", "_f")
