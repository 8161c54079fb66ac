"""P1 summary_stats, P2/P3/P4 bucketize, P5 cohort compare.

Series are filtered values (`when(cond, v)`, NULL otherwise). Buckets of all series are ONE
aggregation with partial (map-side) aggregation, and zero buckets are emitted because every
bucket is its own column before the unpivot; summaries take two passes (operators/quantiles.py).
Empty series come out as n = 0 with NULL statistics (the source's NaN).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.config import Config
from parley.operators import quantiles

QS = (0.5, 0.9, 0.95, 0.99)
STAT_COLS = ["n", "p50", "p90", "p95", "p99", "mean", "max", "min"]


@dataclass
class Series:
    """One population: value column, optional row filter, and key columns naming it."""

    value: Column
    cond: Column | None = None
    keys: dict = field(default_factory=dict)
    total_cond: Column | None = None  # denominator population for bucket pct (default: cond)
    edges: list | None = None  # own bucket edges (else the bucketize call's edges)


def S(value, cond=None, total_cond=None, edges=None, **keys) -> Series:
    v = F.col(value) if isinstance(value, str) else value
    return Series(v, cond, keys, total_cond, edges)


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def _masked(s: Series) -> Column:
    v = s.value.cast("double")
    return v if s.cond is None else F.when(s.cond, v)


def _key_names(series: list[Series]) -> list[str]:
    names: list[str] = []
    for s in series:
        for k in s.keys:
            if k not in names:
                names.append(k)
    return names


def _sql_str(v) -> str:
    if v is None:
        return "CAST(NULL AS STRING)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_num(x) -> str:
    """Exact double literal (the Python float's shortest repr, parsed by the JVM)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _keys_sql(s: Series, keys: list[str]) -> str:
    return "".join(f"'{k}', {_sql_str(s.keys.get(k))}, " for k in keys)


# The per-series / per-bucket aggregates and the unpivot are SQL expression strings over
# helper columns: one JVM call per expression instead of ~10 for the equivalent Column
# arithmetic (report plans have hundreds of such expressions). The plan is the same.

def summary_stats(df: DataFrame, series: list[Series], cfg: Config | None = None) -> DataFrame:
    """N, p50, p90, p95, p99, mean, max, min per series (linear interpolation).

    Quantiles are exact with bounded memory (operators/quantiles.py), whatever the size of the
    input. `cfg.quantile_mode="exact"` uses Spark's `percentile` (one value map a series) and
    `cfg.approx_quantiles` percentile_approx, both inside the one aggregation."""
    cfg = cfg or Config()
    keys = _key_names(series)
    if cfg.approx_quantiles or cfg.quantile_mode == "exact":
        return _one_pass(df, series, cfg, keys)
    found = quantiles.summaries(df, [_masked(s) for s in series], QS, cfg.bounded_accuracy,
                                levels=cfg.quantile_levels).withColumnsRenamed(
        {f"_q{j}": c for j, c in enumerate(STAT_COLS[1:5])})
    # the fixed list of series on the left: empty ones stay, with n = 0
    names = ", ".join(f"named_struct({_keys_sql(s, keys)}'sid', {i})" for i, s in enumerate(series))
    out = (df.sparkSession.range(1).selectExpr(f"inline(array({names}))")
           .join(found, "sid", "left"))
    return out.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), *[r6(F.col(c)).alias(c) for c in STAT_COLS[1:]])


def _one_pass(df: DataFrame, series: list[Series], cfg: Config, keys: list[str]) -> DataFrame:
    helper = df.select(*[_masked(s).alias(f"_x{i}") for i, s in enumerate(series)])
    qs = ", ".join(_sql_num(q) for q in QS)
    aggs = []
    for i in range(len(series)):
        x = f"_x{i}"
        q = (f"percentile_approx({x}, array({qs}), {int(cfg.approx_accuracy)})" if cfg.approx_quantiles
             else f"percentile({x}, array({qs}))")
        aggs += [f"count({x}) AS n{i}", f"avg({x}) AS a{i}", f"max({x}) AS x{i}", f"min({x}) AS m{i}", f"{q} AS q{i}"]
    wide = helper.agg(*[F.expr(a) for a in aggs])

    def r6s(e: str) -> str:
        return f"round(CAST({e} AS DOUBLE), 6)"

    structs = []
    for i, s in enumerate(series):
        ps = "".join(f"'{c}', {r6s(f'q{i}[{j}]')}, " for j, c in enumerate(STAT_COLS[1:5]))
        structs.append(f"named_struct({_keys_sql(s, keys)}'n', CAST(n{i} AS BIGINT), {ps}"
                       f"'mean', {r6s(f'a{i}')}, 'max', {r6s(f'x{i}')}, 'min', {r6s(f'm{i}')})")
    return wide.selectExpr(f"inline(array({', '.join(structs)}))").select(*keys, *STAT_COLS)


def bucketize(df: DataFrame, series: list[Series], edges: list[tuple] | None = None,
              closed: bool = False) -> DataFrame:
    """P2 (half-open [lo, hi)) / P3 (closed [lo, hi]) buckets with n and pct of the series total.

    A value outside every bucket counts in the total but in no bucket; empty buckets
    are kept with n = 0. With several series this is P4 (paired buckets) in long form; a
    series may carry its own edges, so differently bucketed metrics still share one scan.
    """
    cols = []
    for i, s in enumerate(series):
        base = F.lit(True) if s.cond is None else s.cond
        cols += [s.value.cast("double").alias(f"_v{i}"), base.alias(f"_c{i}"),
                 (base if s.total_cond is None else s.total_cond).alias(f"_t{i}")]
    helper = df.select(*cols)
    up = "<=" if closed else "<"
    aggs = []
    for i, s in enumerate(series):
        aggs.append(f"count(CASE WHEN _t{i} THEN 1 END) AS t{i}")
        for j, (_, lo, hi) in enumerate(s.edges or edges):
            aggs.append(f"count(CASE WHEN _c{i} AND _v{i} >= {_sql_num(lo)} AND _v{i} {up} {_sql_num(hi)} "
                        f"THEN 1 END) AS b{i}_{j}")
    wide = helper.agg(*[F.expr(a) for a in aggs])
    keys = _key_names(series)
    structs = []
    for i, s in enumerate(series):
        for j, (label, _, _) in enumerate(s.edges or edges):
            pct = f"CASE WHEN t{i} = 0 THEN 0.0D ELSE round(CAST(100.0D * b{i}_{j} / t{i} AS DOUBLE), 6) END"
            structs.append(f"named_struct({_keys_sql(s, keys)}'bucket_index', {j}, 'bucket', {_sql_str(label)}, "
                           f"'n', CAST(b{i}_{j} AS BIGINT), 'pct', {pct})")
    return wide.selectExpr(f"inline(array({', '.join(structs)}))")


def bucket_index(value: Column, edges: list[tuple], closed: bool = False) -> Column:
    """Index of the bucket a value falls in (NULL outside all buckets)."""
    v = value.cast("double")
    expr = None
    for j, (_, lo, hi) in enumerate(edges):
        inside = (v >= lo) & ((v <= hi) if closed else (v < hi))
        expr = F.when(inside, F.lit(j)) if expr is None else expr.when(inside, F.lit(j))
    return expr


def bucket_label(value: Column, edges: list[tuple], closed: bool = False) -> Column:
    v = value.cast("double")
    expr = None
    for label, lo, hi in edges:
        inside = (v >= lo) & ((v <= hi) if closed else (v < hi))
        expr = F.when(inside, F.lit(label)) if expr is None else expr.when(inside, F.lit(label))
    return expr


def cohort_compare(df: DataFrame, flag: Column, metrics: dict[str, Column], labels=("with", "without"),
                   cfg: Config | None = None, base: Column | None = None) -> DataFrame:
    """P5: split rows by a boolean, n + quantiles of several metrics per side."""
    series = []
    b = F.lit(True) if base is None else base
    for side, cond in ((labels[0], flag), (labels[1], ~flag)):
        for name, col in metrics.items():
            series.append(S(col, b & F.coalesce(cond, F.lit(False)), cohort=side, metric=name))
    return summary_stats(df, series, cfg)
