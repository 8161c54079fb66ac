"""Incremental m04 counts from a growing folder equal the batch counts over the same files."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from parley.functions import time as TM
from parley.streaming import rhythm
from tests.conftest import FIXTURES, rows


def _write_lines(path, convs):
    with open(path, "w", encoding="utf-8") as f:
        for c in convs:
            f.write(json.dumps(c) + "\n")


def _batch_heatmap(spark, src):
    from parley.sources import export
    from parley.sources import schema as SC

    m = export.messages(export.message_rows(spark.read.schema(SC.CONVERSATION).json(src)))
    local = TM.local("created_at", "UTC")
    return m.groupBy(TM.isodow(local).alias("dow"), TM.hour(local).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def test_incremental_equals_batch(spark, tmp_path):
    convs = json.load(open(os.path.join(FIXTURES, "export", "nested", "dir", "conversations.json")))
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    _write_lines(src / "part-1.json", convs[:3])
    for q in rhythm.start(spark, str(src), str(out), str(ck)):
        q.awaitTermination(120)
    first = rows(spark.read.parquet(str(out / "heatmap")))
    assert first == rows(_batch_heatmap(spark, str(src)))

    _write_lines(src / "part-2.json", convs[3:])  # more files arrive; same checkpoint resumes
    for q in rhythm.start(spark, str(src), str(out), str(ck)):
        q.awaitTermination(120)
    assert rows(spark.read.parquet(str(out / "heatmap"))) == rows(_batch_heatmap(spark, str(src)))
    daily = rows(spark.read.parquet(str(out / "daily")))
    assert daily == [("2024-03-04", 26)]
