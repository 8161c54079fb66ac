from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              conf: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests / bench; on a cluster the submitter's session is reused."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName("parley")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Python call-site capture for error messages costs several JVM round trips per
        # Column function while plans are built; report plans have hundreds of expressions
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001 — Spark Connect
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; only set one when none is configured."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not (spark.conf.get("spark.master", None) or "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="parley-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 — Spark Connect sessions have no SparkContext; parquet paths suffice
        pass
    return d
