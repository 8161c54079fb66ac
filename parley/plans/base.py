"""Report registry (W6) and the per-dataset context every report reads."""

from __future__ import annotations

from collections.abc import Callable
import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from parley.config import Config
from parley.plans import prepare
from parley.sources.load_metrics import LoadMetrics
from parley.sources.tables import Tables


@dataclass
class Context:
    spark: SparkSession
    tables: Tables
    stats: prepare.Stats
    cfg: Config
    materialized: bool = False
    load: LoadMetrics | None = None  # figures of the load, where this context made it
    _derived: dict = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def derived(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table several reports read (e.g. message gaps): built once; when the context is
        materialised it is written as parquet in the checkpoint folder and read back, so
        the window behind it runs once and later passes are column-pruned scans."""
        with self._lock:
            df = self._derived.get(name)
            if df is None:
                df = build()
                if self.materialized:
                    path = prepare.scratch_dir(self.spark, f"derived-{name}")
                    df.write.mode("overwrite").parquet(path)
                    df = self.spark.read.schema(df.schema).parquet(path)
                self._derived[name] = df
            return df


REGISTRY: dict[str, tuple[str, Callable[[Context], DataFrame]]] = {}
# input tables a report needs beyond messages / conversations (e.g. "attachments")
NEEDS: dict[str, tuple[str, ...]] = {}
ROW_LEVEL: set[str] = set()


def report(module: str, key: str, needs: tuple[str, ...] = (), row_level: bool = False):
    """Register `fn(ctx) -> DataFrame` as report `key` of `module` (m01 ... m13, overview); the rows
    of a `row_level` report grow with the data."""

    def deco(fn):
        if row_level:
            ROW_LEVEL.add(key)
        REGISTRY[key] = (module, fn)
        NEEDS[key] = needs
        return fn

    return deco


def runnable(key: str, t: Tables) -> bool:
    return all(getattr(t, n, None) is not None for n in NEEDS.get(key, ()))


def module_keys(module: str) -> list[str]:
    return [k for k, (m, _) in REGISTRY.items() if m == module]


def run_module(module: str, ctx: Context) -> dict[str, DataFrame]:
    """All frames of one module, by key (lazy; shared derived tables and counts of hot groups run while they are built)."""
    if not module_keys(module):
        raise KeyError(f"unknown module: {module}")
    return {k: REGISTRY[k][1](ctx) for k in module_keys(module) if runnable(k, ctx.tables)}


_CACHE: dict[tuple, Context] = {}
_LOCK = threading.Lock()


def _session_key(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 — Spark Connect: no SparkContext
        return f"session-{id(spark)}"


def context_for_testdata(spark: SparkSession, sf_dir: str, cfg: Config | None = None,
                         materialize: bool = True) -> Context:
    """Context over the driver test tables; stats are written once per app + dataset."""
    cfg = cfg or Config()
    # the driver tables hold UTC wall clocks (parquet timestamps without zone); reading them as
    # instants and the session-zone months (m03 / m11) assume a UTC session
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (_session_key(spark), sf_dir, cfg, materialize)
    with _LOCK:  # one build per dataset even when queries arrive from several threads
        return _CACHE.get(key) or _build_testdata_context(spark, sf_dir, cfg, materialize, key)


def _build_testdata_context(spark: SparkSession, sf_dir: str, cfg: Config, materialize: bool, key) -> Context:
    from parley.session import ensure_checkpoint_dir
    from parley.sources import testdata

    ensure_checkpoint_dir(spark)
    t = testdata.load(spark, sf_dir, prepare.scratch_dir(spark, "testdata") if materialize else None)
    if materialize:
        t = materialize_tables(spark, t, REREAD_TABLES)
    stats = prepare.build_materialized(t, cfg, spark) if materialize else prepare.build(t, cfg)
    ctx = Context(spark, t, stats, cfg, materialized=materialize)
    _CACHE[key] = ctx
    return ctx


ALL_TABLES = ("messages", "conversations", "tool_calls", "tool_results", "citations", "projects", "docs",
              "attachments", "files", "blocks", "users")
# driver-table adapters: messages / conversations are column arithmetic read once (by prepare)
REREAD_TABLES = ("citations", "projects", "docs")  # tool tables come from staged tool events
# content blocks by type (a handful of values): type-filtered reads skip the other folders
PARTITION_BY = {"blocks": ["type"]}


def materialize_tables(spark: SparkSession, t: Tables, names: tuple[str, ...] = ALL_TABLES,
                       base: str | None = None, metrics: LoadMetrics | None = None) -> Tables:
    """Persist the normalised tables (the ETL output) once as parquet in the shared checkpoint
    folder: parsing / derivation runs once, later readers get pruning and pushdown, and a
    lost executor re-reads files instead of recomputing lineage. `metrics` keeps the figures taken while writing."""
    from dataclasses import replace

    base = base or prepare.scratch_dir(spark, "tables")
    metrics = metrics or LoadMetrics()
    done = {}
    for name in names:
        df = getattr(t, name)
        if df is not None:  # filters on a partition column prune whole folders
            done[name] = metrics.write(name, df, f"{base}/{name}", PARTITION_BY.get(name))
    return replace(t, **done)


def context_for_tables(spark: SparkSession, t: Tables, cfg: Config | None = None,
                       materialize: bool = False) -> Context:
    cfg = cfg or Config()
    stats = prepare.build_materialized(t, cfg, spark) if materialize else prepare.build(t, cfg)
    return Context(spark, t, stats, cfg, materialized=materialize)


def context_for_export(spark: SparkSession, root: str, cfg: Config | None = None, multiline: bool | None = None,
                       tables_dir: str | None = None) -> Context:
    """Context over one chat export folder: the JSON is parsed once into staged parquet under
    the shared checkpoint folder, the normalised and stat tables are written once and every report
    reads those files. Counts, missing keys and consistency are taken while writing.

    tables_dir: publish the tables there (W5): they go into a new version folder, which readers
    (`published.table`) see only when all of it is written and checked."""
    from parley.session import ensure_checkpoint_dir
    from parley.sources import export, published

    ensure_checkpoint_dir(spark)
    cfg = cfg or Config()
    base = published.begin(tables_dir) if tables_dir else prepare.scratch_dir(spark, "tables")
    metrics = LoadMetrics()
    t = export.load_dir(spark, root, multiline, stage_dir=prepare.scratch_dir(spark, "export"))
    t = materialize_tables(spark, t, base=base, metrics=metrics)
    export.validate(t)
    metrics.check()
    stats = prepare.build_materialized(t, cfg, spark, base_dir=f"{base}/stats" if tables_dir else None)
    prepare.assert_sane(stats)
    if tables_dir:
        held = {n: (getattr(t, n).schema, f["rows"]) for n, f in metrics.figures.items()}
        held.update({f"stats/{n}": (getattr(stats, n).schema, None) for n in ("message", "code_block", "conversation")})
        published.commit(spark, base, held)
    return Context(spark, t, stats, cfg, materialized=True, load=metrics)
