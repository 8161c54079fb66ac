"""Exact quantiles with bounded memory.

Spark's exact `percentile` merges a value -> count map of a whole group in one task, and lengths,
sums, gaps and durations take more distinct values the more data there is. Here, at every size,
per group:

  pass 1  one aggregation: n, min, max and a sketch (`percentile_approx`, rank error
          <= n / accuracy) at q - d and q + d for every requested q (d = 3 / accuracy);
  pass 2  the brackets join back as ONE row per group. They come in ascending order, so every row has one
          place: the first bracket that ends at or above it (its block), and there its value, or, below that
          bracket's start, the block's one cell without a value. One aggregation counts the rows per
          cell for all quantiles together (duplicates collapse, partial aggregation folds the cells without values);
  pass 3  per (group, block) a running count over its cells, on top of the earlier blocks' totals, finds the values
          at ranks floor((n-1)q) and ceil((n-1)q), interpolated as Spark's `percentile` does.

Between passes 1 and 2, groups whose brackets may still hold more than `limit` rows are narrowed (`narrowed`), at
most `levels` times: one aggregation counts the rows below and inside each bracket and takes a second sketch of the
rows inside alone, at GRID evenly spaced points; with the exact count below known, the bracket becomes the few points
around the wanted rank, about 1 / 240 of its rows. Such groups hold over limit * accuracy / 8 rows, so their
brackets are a bounded broadcast, and where there are none AQE finds the broadcast empty and drops the level's scan.

For n <= 10 * accuracy the bracket is the whole group (at most that many rows). Above that, 3n/accuracy covers the
sketch error plus the one-rank gap between the sketch's q*n rank and the (n-1)q interpolation rank. No task holds
more than max(10 * accuracy, limit) values of a bracket, however large or skewed the group is, up to n = limit *
accuracy / 8 * 238^levels (10^12 rows a group by default, 2.8 * 10^14 with Config(quantile_levels=2); beyond that
brackets grow, results stay exact).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


LIMIT = 4_000_000  # rows a bracket may hold before it is narrowed
LEVELS = 1
FACTS = ["_n", "_mean", "_min", "_max"]
GRID = 1000  # points of a narrowing sketch, whose error is a tenth of a step
SHRINK = 4 / GRID + 2 / (10 * GRID)  # at most four steps and twice the sketch's error are left


def grouped_exact(long: DataFrame, groups: list[str], value: str, qs: tuple[float, ...], accuracy: int = 10000,
                  small_groups: bool = False, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """Rows (groups..., qi, value): quantile qs[qi] of `value` per group (NULL values ignored).

    small_groups: the group list is tiny and fixed (e.g. a few series), so the bracket
    row may be broadcast; otherwise Spark picks the join (AQE splits skewed groups)."""
    long = long.where(F.col(value).isNotNull())
    wide = refined(long, sketched(long, groups, value, qs, accuracy), groups, value, qs, accuracy, small_groups, limit, levels)
    return wide.select(*groups, F.inline(F.array(*[F.struct(F.lit(k).alias("qi"), F.col(f"_q{k}").alias("value"))
                                                  for k in range(len(qs))])))


def sketched(long: DataFrame, groups: list[str], value: str, qs: tuple[float, ...], accuracy: int) -> DataFrame:
    """Pass 1: count, mean, ends and the sketch's values around every quantile."""
    d, x = 3.0 / accuracy, F.col(value)
    brackets = [b for q in qs for b in (max(0.0, q - d), min(1.0, q + d))]
    return long.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mean"), F.min(x).alias("_min"), F.max(x).alias("_max"),
        F.percentile_approx(x, brackets, accuracy).alias("_b"))


def brackets(p1: DataFrame, groups: list[str], qs: list[float], accuracy: int, at: list[int]) -> DataFrame:
    """Rows (groups..., facts..., _L0, _H0, ..., _m): the bracket of each quantile (ascending), rows in the widest at most."""
    d, whole = 3.0 / accuracy, F.col("_n") <= 10 * accuracy
    # a bracket end clipped to q = 0 / 1 is the exact min / max from pass 1 (not a sketch value)
    ends = [c for i, (q, k) in enumerate(zip(qs, at)) for c in (
        F.when(whole | F.lit(q - d <= 0.0), F.col("_min")).otherwise(F.col("_b")[2 * k]).alias(f"_L{i}"),
        F.when(whole | F.lit(q + d >= 1.0), F.col("_max")).otherwise(F.col("_b")[2 * k + 1]).alias(f"_H{i}"))]
    most = F.when(whole, F.col("_n").cast("double")).otherwise(F.col("_n") * min(1.0, 8.0 / accuracy))
    return p1.select(*groups, *FACTS, *ends, most.alias("_m"))


def narrowed(long: DataFrame, br: DataFrame, groups: list[str], value: str, qs: list[float], limit: int) -> DataFrame:
    """The same rows; brackets that may hold more than `limit` rows cut to the grid points around their ranks.

    Both halves keep every column, so the aggregation below them is planned alike and run once."""
    wide = F.lit(False)
    for i in range(len(qs)):
        wide = wide | (F.col(f"_H{i}") > F.col(f"_L{i}"))
    is_open = (F.col("_m") > limit) & wide
    # at most (all rows) / limit groups
    open_ = F.broadcast(br.where(is_open).drop("_m"))
    x, facts = F.col(value), [*FACTS, *[f"_{e}{i}" for i in range(len(qs)) for e in "LH"]]
    # one folded expression, not GRID literals for every planning rule to walk through
    grid = f"CAST(split('{' '.join(repr(j / GRID) for j in range(GRID + 1))}', ' ') AS ARRAY<DOUBLE>)"
    aggs = []
    for i in range(len(qs)):
        inside = f"`{value}` >= _L{i} AND `{value}` <= _H{i}"
        aggs += [F.count_if(x < F.col(f"_L{i}")).alias(f"_below{i}"), F.expr(f"count_if({inside})").alias(f"_in{i}"),
                 F.expr(f"percentile_approx(CASE WHEN {inside} THEN `{value}` END, {grid}, {10 * GRID})").alias(f"_g{i}")]
    seen = long.join(open_, groups).groupBy(*groups, *facts).agg(*aggs)
    ends, left = [], []
    for i, q in enumerate(qs):
        low, high, n_in, points = F.col(f"_L{i}"), F.col(f"_H{i}"), F.col(f"_in{i}"), F.col(f"_g{i}")
        pos = (F.col("_n") - 1) * F.lit(q)
        step = F.lit(GRID) / F.greatest(n_in, F.lit(1))
        first = F.floor((F.floor(pos) - F.col(f"_below{i}")) * step).cast("int") - 1
        last = F.ceil((F.ceil(pos) + 1 - F.col(f"_below{i}")) * step).cast("int") + 1
        cut = n_in > 4 * GRID  # fewer rows than that need no narrowing
        ends += [F.when(cut & first.between(1, GRID), F.get(points, first)).otherwise(low).alias(f"_L{i}"),
                 F.when(cut & last.between(0, GRID - 1), F.get(points, last)).otherwise(high).alias(f"_H{i}")]
        left.append(F.when(high > low, n_in * SHRINK).otherwise(F.lit(0.0)))
    most = F.greatest(*left) if len(left) > 1 else left[0]
    return br.where(~is_open).unionByName(seen.select(*groups, *FACTS, *ends, most.alias("_m")))


def refined(long: DataFrame, p1: DataFrame, groups: list[str], value: str, qs: tuple[float, ...], accuracy: int,
            small_groups: bool, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """Passes 2 and 3: rows (groups..., _n, _mean, _min, _max, _q0, _q1, ...) with the quantiles qs[0], qs[1], ...

    Pass 1's facts go along with the cells as further grouping columns (the same ones on all cells of a group), so that
    nobody needs to join pass 1 once more, which Spark would run again with other columns."""
    x, facts = F.col(value), FACTS
    up = sorted(range(len(qs)), key=lambda k: qs[k])
    ascending = [qs[k] for k in up]
    br = brackets(p1, groups, ascending, accuracy, up)
    for _ in range(levels):
        br = narrowed(long, br, groups, value, ascending, limit)
    br = br.drop("_m")
    block, cell = F, F
    for i in range(len(qs)):
        block = block.when(x <= F.col(f"_H{i}"), F.lit(i))
        cell = cell.when(x <= F.col(f"_H{i}"), F.when(x >= F.col(f"_L{i}"), x))
    hist = (long.join(F.broadcast(br) if small_groups else br, groups)
            .select(*groups, *facts, block.alias("_block"), cell.alias("_x")).where(F.col("_block").isNotNull())
            .groupBy(*groups, *facts, "_block", "_x").agg(F.count(F.lit(1)).alias("_c")))
    # rows in the blocks before each block: one row a group
    offsets = hist.groupBy(*groups).agg(F.lit(0).cast("long").alias("_o0"), *[
        F.coalesce(F.sum(F.when(F.col("_block") < i, F.col("_c"))), F.lit(0)).alias(f"_o{i}") for i in range(1, len(qs))])
    before = F
    for i in range(len(qs)):
        before = before.when(F.col("_block") == i, F.col(f"_o{i}"))
    w = (Window.partitionBy(*groups, "_block").orderBy(F.col("_x").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    h = (hist.join(F.broadcast(offsets) if small_groups else offsets, groups)
         .withColumn("_upto", before + F.sum("_c").over(w)))
    ranks = [(k, (F.col("_n") - 1) * F.lit(q)) for k, q in enumerate(qs)]
    picked = h.groupBy(*groups, *facts).agg(*[
        F.min_by("_x", F.when(F.col("_upto") > end, F.col("_upto"))).alias(f"_{name}{k}")
        for k, pos in ranks for name, end in (("lo", F.floor(pos)), ("hi", F.ceil(pos)))])
    out = []
    for k, pos in ranks:
        lo, hi, fl, ce = F.col(f"_lo{k}"), F.col(f"_hi{k}"), F.floor(pos), F.ceil(pos)
        val = F.when(fl == ce, lo).otherwise((ce - pos) * lo + (pos - fl) * hi)
        # never a silently wrong value: both ranks must fall on cells with a value (guaranteed by
        # the sketch bound; checked anyway)
        out.append(F.when(lo.isNotNull() & hi.isNotNull(), val).otherwise(F.raise_error(F.lit(
            "bounded quantile bracket missed its rank; raise Config.bounded_accuracy")).cast("double")).alias(f"_q{k}"))
    return picked.select(*groups, *facts, *out)


def summaries(df: DataFrame, values: list[Column], qs: tuple[float, ...], accuracy: int = 10000, limit: int = LIMIT,
              levels: int = LEVELS) -> DataFrame:
    """(sid, n, mean, max, min, _q0, _q1, ...): count, ends and quantiles qs[0], qs[1], ... of `values[sid]` over df, for
    series that have values."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("sid"), v.cast("double").alias("x"))
                                        for i, v in enumerate(values)]))).where(F.col("x").isNotNull())
    found = refined(long, sketched(long, ["sid"], "x", qs, accuracy), ["sid"], "x", qs, accuracy, small_groups=True, limit=limit,
                    levels=levels)
    return found.withColumnsRenamed({f"_{c}": c for c in ("n", "mean", "max", "min")})


def exact_bounded(df: DataFrame, values: list[Column], qs: tuple[float, ...], accuracy: int = 10000, limit: int = LIMIT,
                  levels: int = LEVELS) -> DataFrame:
    """One row per (sid, qi): quantile qs[qi] of `values[sid]` over df (series form)."""
    return summaries(df, values, qs, accuracy, limit, levels).select("sid", F.inline(F.array(*[
        F.struct(F.lit(k).alias("qi"), F.col(f"_q{k}").alias("value")) for k in range(len(qs))])))


def grouped_quantiles(df: DataFrame, groups: list[str], value: Column, qs: tuple[float, ...], cfg,
                      few_groups: bool = False) -> DataFrame:
    """(groups..., p<q>...) with the quantiles of `value` per group (groups without values are absent)."""
    names = [f"p{int(round(q * 100))}" for q in qs]
    long = df.select(*groups, value.cast("double").alias("_v"))
    if cfg.approx_quantiles or cfg.quantile_mode == "exact":
        one = (F.percentile_approx("_v", list(qs), cfg.approx_accuracy) if cfg.approx_quantiles
               else F.percentile("_v", list(qs)))
        g = long.where(F.col("_v").isNotNull()).groupBy(*groups).agg(one.alias("_q"))
        return g.select(*groups, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    long = long.where(F.col("_v").isNotNull())
    q = refined(long, sketched(long, groups, "_v", qs, cfg.bounded_accuracy), groups, "_v", qs, cfg.bounded_accuracy, few_groups,
                levels=cfg.quantile_levels)
    return q.select(*groups, *[F.col(f"_q{i}").alias(n) for i, n in enumerate(names)])
