"""P9 first-vs-rest and per-group top-k helpers.

`flag_first` avoids a window over the group: the earliest row per group is found by a
min-over-struct aggregation (partial aggregation, so a hot group costs one small row per
map task) and joined back on the row id (a unique key, so no skewed join partition).
A `row_number()` window would sort a whole hot group inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def order_key(*cols: Column | str, desc: bool = False) -> Column:
    """Struct whose min() is the first row ascending (desc=False) or whose max() is the first
    row descending (desc=True), NULLs last either way (DuckDB's default order)."""
    parts = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts += [c.isNotNull() if desc else c.isNull(), c]
    return F.struct(*parts)


def flag_first(df: DataFrame, group: str, order: list[Column | str], id_col: str,
               name: str = "is_first", last: bool = False) -> DataFrame:
    """Add boolean `name`: row is the first (or last) of its group by `order`, ties by id."""
    key = order_key(*order, id_col, desc=last)
    agg = F.max(F.struct(key.alias("k"), F.col(id_col).alias("id"))) if last else \
        F.min(F.struct(key.alias("k"), F.col(id_col).alias("id")))
    firsts = df.groupBy(group).agg(agg.alias("_f")).select(F.col("_f.id").alias(id_col), F.lit(True).alias(name))
    return df.join(firsts, id_col, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """First k rows by a total order (TakeOrderedAndProject: per-partition top-k, k rows merged)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], k: int, order: list[Column], rank_col: str = "rank",
                    target_rows: int = 2_000_000) -> DataFrame:
    """Per-group top-k by a total order, safe for hot groups.

    Rows per group are counted first (partial aggregation). Groups above `target_rows` are
    salted by a row hash into ceil(n / target_rows) sub-groups; each sub-group keeps its own
    top k (a window over about target_rows rows), and the final top k is taken over those
    survivors (k rows per sub-group). Without hot groups this is the plain window."""
    hot = (df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target_rows)
           .select(*group, F.ceil(F.col("_n") / F.lit(target_rows)).cast("long").alias("_nb")))
    final = Window.partitionBy(*group).orderBy(*order)
    if not hot.isEmpty():  # a small aggregate job, bounded by total_rows / target_rows groups
        salt = F.when(F.col("_nb").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]),
                                                                        F.col("_nb")))
        s = df.join(F.broadcast(hot), group, "left").withColumn("_salt", salt)
        first = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = s.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r", "_salt", "_nb")
    return df.withColumn(rank_col, F.row_number().over(final)).where(F.col(rank_col) <= k)
