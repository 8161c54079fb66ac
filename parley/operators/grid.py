"""P7 zero-filled grids and P8 top-k helpers for bounded report axes.

Axes are array expressions (a fixed sequence such as hours 0..23, or a scalar subquery
over an already-reduced frame such as the top-5 names). `explode` of the axis builds the
cells, so no join-without-keys is planned; the counts are then left-joined on the cell key.
Both inputs are report-sized by construction (axis length x distinct months etc.).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def axis(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def seq(lo: int, hi: int) -> Column:
    return F.sequence(F.lit(lo), F.lit(hi))


def cells(base: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """base rows x every axis value (explode per axis)."""
    out = base
    for name, values in axes.items():
        out = out.select("*", F.explode(values).alias(name))
    return out


def zero_fill(cells_df: DataFrame, counts: DataFrame, keys: list[str], value_cols: list[str]) -> DataFrame:
    """Left-join counts onto the grid cells; missing cells get 0."""
    j = cells_df.join(counts, keys, "left")
    return j.select(*[c for c in cells_df.columns],
                    *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in value_cols])


def names_array(top: DataFrame, name_col: str, order: Column) -> Column:
    """Scalar subquery: the (bounded) top-k names as one array sorted by `order`."""
    return top.agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(name_col).alias("v")))),
                    lambda s: s["v"]).alias("names")
    ).scalar()


def dense_rows(counts: DataFrame, row_key: str, col_key: str, value: str, names: Column) -> DataFrame:
    """Every row of `counts` x every name of the (bounded) `names` axis, zero-filled.

    One aggregation: each row key folds its (name -> value) pairs into a map (at most
    len(names) entries, since counts were restricted to those names), then the axis is
    exploded and looked up; the counts are not read twice (no self-join for the row axis)."""
    per = counts.groupBy(row_key).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(col_key), F.col(value)))).alias("_m"))
    cells_df = per.select(row_key, F.explode(names).alias(col_key), "_m")
    return cells_df.select(row_key, col_key,
                           F.coalesce(F.try_element_at(F.col("_m"), F.col(col_key)), F.lit(0)).cast("long").alias(value))
