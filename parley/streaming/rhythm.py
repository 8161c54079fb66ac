"""Incremental activity rhythm (m04) over an export that arrives as files.

New conversation files (JSON Lines, one conversation per line) land in a folder; the same
row-local normalisation as the batch ingest turns them into messages, and the m04 message
counts (hour x ISO weekday, and per local day) are kept as streaming aggregations.

Output mode is `complete`: the state is one row per (weekday, hour) cell and one per day, so
it stays small, and no late message is ever dropped (there is no watermark cut-off). Each
micro-batch overwrites its parquet table idempotently through `foreachBatch`, and progress
is tracked in a checkpoint folder that must live on shared storage (it defaults to a
sub-folder of the session's spark.checkpoint.dir).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.functions import time as TM
from parley.sources import export
from parley.sources import schema as SC


def message_stream(spark: SparkSession, src_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming messages (E5 + S2) from conversation JSON Lines files."""
    raw = (spark.readStream.schema(SC.CONVERSATION).option("maxFilesPerTrigger", max_files_per_trigger)
           .option("mode", "PERMISSIVE").json(src_dir))
    return export.messages(export.message_rows(raw))


def heatmap_counts(messages: DataFrame, tz: str) -> DataFrame:
    """m04.1 message counts per (ISO weekday, local hour) — sparse; the batch report zero-fills."""
    local = TM.local("created_at", tz)
    return messages.groupBy(TM.isodow(local).alias("dow"), TM.hour(local).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"))


def daily_counts(messages: DataFrame, tz: str) -> DataFrame:
    """Messages per local day (m04.2 / m04.3 roll up from these rows)."""
    return messages.groupBy(TM.day(TM.local("created_at", tz)).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _overwrite(path: str):
    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)  # complete result: <= 168 or #days rows

    return write


def start(spark: SparkSession, src_dir: str, out_dir: str, checkpoint_dir: str | None = None, tz: str = "UTC",
          available_now: bool = True) -> list[StreamingQuery]:
    """Start the two incremental counts; `available_now` processes what is there and stops."""
    if checkpoint_dir is None:
        from parley.plans.prepare import scratch_dir

        checkpoint_dir = scratch_dir(spark, "rhythm-stream")
    msgs = message_stream(spark, src_dir)
    queries = []
    for name, frame in (("heatmap", heatmap_counts(msgs, tz)), ("daily", daily_counts(msgs, tz))):
        w = (frame.writeStream.outputMode("complete").foreachBatch(_overwrite(f"{out_dir}/{name}"))
             .option("checkpointLocation", f"{checkpoint_dir}/{name}"))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
        queries.append(w.start())
    return queries
