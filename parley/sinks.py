"""Report outputs (CSV, JSON summaries), non-finite cleanup, table materialisation.

Report frames that are aggregates (report-sized by construction) are written as one file
(`coalesce(1)`); row-level frames (one row per message / citation / domain / tool name ..., declared
as `row_level` where the report is registered) keep their partitioning and are written in
parallel. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from parley.plans import prepare
from parley.plans.base import REGISTRY, ROW_LEVEL, Context, module_keys, runnable


def sanitize_nonfinite(df: DataFrame) -> DataFrame:
    """NaN / +-Inf -> NULL in every floating column (JSON has no non-finite numbers)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            bad = F.isnan(c) | (c == float("inf")) | (c == float("-inf"))
            cols.append(F.when(bad, F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def _sized(df: DataFrame, bounded: bool) -> DataFrame:
    return df.coalesce(1) if bounded else df


def write_csv(df: DataFrame, path: str, bounded: bool = True) -> None:
    """CSV with header, UTF-8 (array / struct columns rendered as JSON text)."""
    cols = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map")
            else F.col(f"`{f.name}`") for f in df.schema.fields]
    (_sized(df.select(*cols), bounded).write.mode("overwrite").option("header", True)
     .option("encoding", "UTF-8").csv(path))


def write_json(df: DataFrame, path: str, bounded: bool = True) -> None:
    """JSON lines of a report frame (non-finite values already nulls)."""
    _sized(sanitize_nonfinite(df), bounded).write.mode("overwrite").json(path)


def summary_document(frames: dict[str, DataFrame]) -> DataFrame:
    """One JSON document per module: {key: [rows...]} for its aggregate frames.

    Each aggregate frame folds to one array-of-structs value inside Spark; the module
    document is the union of those single-row frames, pivoted into one object by key."""
    parts = []
    for key, df in frames.items():
        if key in ROW_LEVEL:
            continue
        clean = sanitize_nonfinite(df)
        parts.append(clean.agg(F.to_json(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in clean.columns])))
                               .alias("rows")).select(F.lit(key).alias("key"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # keys are registry identifiers ([a-z0-9_]), so they need no JSON escaping
    entry = F.concat(F.lit('"'), F.col("key"), F.lit('":'), F.col("rows"))
    return out.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}"))
                   .alias("summary"))


def chart_buckets(df: DataFrame) -> DataFrame:
    """Bucket frames as chart rows {label, count, pct} (other keys kept in front)."""
    keep = [c for c in df.columns if c not in ("bucket", "n", "pct", "bucket_index")]
    return df.orderBy(*keep, "bucket_index").select(*keep, F.col("bucket").alias("label"),
                                                     F.col("n").alias("count"), "pct")


def materialise(tables: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """Drop-and-recreate parquet tables (idempotent: overwrite)."""
    paths = {}
    for name, df in tables.items():
        if df is None:
            continue
        p = f"{out_dir.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(p)
        paths[name] = p
    return paths


def write_module(module: str, ctx: Context, out_dir: str) -> list[str]:
    """W6 + W1/W2: run one module and write each frame as CSV and JSON plus its summary."""
    written = []
    base = out_dir.rstrip("/") + "/" + module
    scratch = prepare.scratch_dir(ctx.spark, f"reports-{module}")
    frames = {}
    for key in module_keys(module):
        if not runnable(key, ctx.tables):
            continue
        bounded = key not in ROW_LEVEL
        # every frame runs once: CSV, JSON and the summary read its rows back
        df = sanitize_nonfinite(REGISTRY[key][1](ctx))
        _sized(df, bounded).write.parquet(f"{scratch}/{key}")
        frames[key] = ctx.spark.read.schema(df.schema).parquet(f"{scratch}/{key}")
        write_csv(frames[key], f"{base}/{key}.csv", bounded)
        write_json(frames[key], f"{base}/{key}.json", bounded)
        written.append(key)
    if set(frames) - ROW_LEVEL:
        summary_document(frames).coalesce(1).write.mode("overwrite").text(f"{base}/summary.json")
    return written
