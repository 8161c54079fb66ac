"""E11 / E13 without a scan of their own: figures gathered while the tables are written.

`observed` puts an observation on the frame that a write takes. It stands at the end of the plan, in the
write's last stage, where Spark counts each partition's figures once, also when a lost executor's tasks run
again. Per table: rows, rows without a whole key, and for the content blocks those of type tool_use. The
figures are one row a table and come to the driver with the write.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parley.sources import export


FOLDERS, FOLDER_BUFFER = 16, 16 << 20  # files of a task open at a time, bytes that each holds back
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def unsorted(spark: SparkSession) -> Iterator[None]:
    """Writes into up to FOLDERS partition folders without sorting the rows first (Spark sorts what comes beyond)."""
    before = spark.conf.get(OPEN_FILES, None)
    spark.conf.set(OPEN_FILES, str(FOLDERS))
    try:
        yield
    finally:
        spark.conf.unset(OPEN_FILES) if before is None else spark.conf.set(OPEN_FILES, before)


@dataclass
class LoadMetrics:
    """Figures of the tables of one load by table name (after their writes)."""

    figures: dict[str, dict[str, int]] = field(default_factory=dict)

    def write(self, name: str, df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write `df` to `path` as Parquet with its figures taken on the way, and return the written table."""
        seen = Observation(f"load {name}")
        w = observed(name, df, seen).write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            with unsorted(df.sparkSession):
                w.partitionBy(*partition_by).option("parquet.block.size", FOLDER_BUFFER).parquet(path)
        else:
            w.parquet(path)
        got = seen.get
        back = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
        # a plan that Spark reduces to nothing (an empty input) observes nothing: count what was written
        self.figures[name] = dict(got) if "rows" in got else back.agg(*_figures(name, df)).first().asDict()
        return back

    def counts(self, spark: SparkSession) -> DataFrame:
        """Rows per table of PRIMARY_KEYS, as `export.load_counts` gives them."""
        rows = [(n, self.figures[n]["rows"]) for n in export.PRIMARY_KEYS if n in self.figures]
        return spark.createDataFrame(rows, "table string, rows long")

    def consistency(self, spark: SparkSession) -> DataFrame:
        """tool_use blocks against tool_calls rows, as `export.consistency` gives them."""
        a, b = self.figures["blocks"]["tool_use"], self.figures["tool_calls"]["rows"]
        return spark.createDataFrame([(a, b, a == b)], "tool_use_blocks long, tool_calls long, consistent boolean")

    def check(self) -> None:
        """Raise when rows without a whole key were written, or blocks and calls differ in number."""
        bare = {n: f["bare"] for n, f in self.figures.items() if f["bare"]}
        if bare:
            raise ValueError("key violations: " + "; ".join(f"{n}: {k} rows (missing key)" for n, k in bare.items()))
        if {"blocks", "tool_calls"} <= set(self.figures) and self.figures["blocks"]["tool_use"] != self.figures["tool_calls"]["rows"]:
            raise ValueError("the number of tool_use blocks and of tool calls differ")


def observed(name: str, df: DataFrame, into: Observation) -> DataFrame:
    return df.observe(into, *_figures(name, df))


def _figures(name: str, df: DataFrame) -> list:
    bare = F.count_if(export._missing_key(export.PRIMARY_KEYS.get(name, [])))
    tool_use = F.count_if(F.col("type") == "tool_use") if name == "blocks" else F.lit(0).cast("long")
    return [F.count(F.lit(1)).alias("rows"), bare.alias("bare"), tool_use.alias("tool_use")]
