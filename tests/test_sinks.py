"""W1-W6 output writers."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import functions as F

from parley import sinks
from parley.plans.base import run_module
from parley.sources import published


def test_sanitize_nonfinite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r["x"] for r in sinks.sanitize_nonfinite(df).collect()] == [1.0, None, None, None]


def test_write_module_csv_json_summary(jctx, tmp_path):
    written = sinks.write_module("m12", jctx, str(tmp_path))
    assert "m12_post_error" in written
    csvs = glob.glob(f"{tmp_path}/m12/m12_post_error.csv/*.csv")
    assert len(csvs) == 1  # aggregate frame -> one file
    with open(csvs[0], encoding="utf-8") as f:
        assert f.readline().strip() == "outcome_index,outcome,n,pct"
    summary_files = glob.glob(f"{tmp_path}/m12/summary.json/part-*")
    doc = json.loads(open(summary_files[0], encoding="utf-8").read())
    assert len(doc["m12_post_error"]) == 5 and "m12_error_messages" not in doc


def test_materialise_is_idempotent(spark, export_tables, tmp_path):
    t = {"messages": export_tables.messages.select("message_uuid", "chars_text")}
    p1 = sinks.materialise(t, str(tmp_path))
    p2 = sinks.materialise(t, str(tmp_path))
    assert p1 == p2 and spark.read.parquet(p1["messages"]).count() == 26
    assert os.path.isdir(p1["messages"])


def test_chart_buckets_shape(jctx):
    frames = run_module("m01", jctx)
    c = sinks.chart_buckets(frames["m01_buckets"])
    assert c.columns == ["metric", "label", "count", "pct"]
    assert c.where(F.col("metric") == "message_count").count() == 6


def test_cli_writes_tables_and_reports(spark, tmp_path):
    from parley.__main__ import main
    from tests.conftest import FIXTURES

    assert main([os.path.join(FIXTURES, "export"), str(tmp_path), "--modules", "m12,overview", "--tz", "UTC"]) == 0
    assert published.table(spark, str(tmp_path / "tables"), "messages").count() == 26
    assert published.table(spark, str(tmp_path / "tables"), "stats/conversation").count() == 8
    assert glob.glob(f"{tmp_path}/reports/m12/summary.json/part-*")
    assert glob.glob(f"{tmp_path}/reports/overview/overview_blocks.csv/*.csv")


def test_cli_on_json_lines_part_folders(spark, tmp_path):
    import json

    from parley.__main__ import main
    from tests.conftest import FIXTURES

    src = os.path.join(FIXTURES, "export")
    layout = {"conversations": "nested/dir/conversations.json", "projects": "nested/projects.json", "users": "users.json"}
    for name, rel in layout.items():
        arr = json.load(open(os.path.join(src, rel), encoding="utf-8"))
        (tmp_path / "in" / name).mkdir(parents=True)
        for part in range(3):
            with open(tmp_path / "in" / name / f"part-{part}.json", "w", encoding="utf-8") as f:
                for item in arr[part::3]:
                    f.write(json.dumps(item) + "\n")
    assert main(["--jsonl", "--modules", "m12", "--tz", "UTC", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    doc = json.loads(open(glob.glob(f"{tmp_path}/out/reports/m12/summary.json/part-*")[0], encoding="utf-8").read())
    assert sorted(r["n"] for r in doc["m12_post_error"]) == [1, 1, 1, 1, 1]
    assert published.table(spark, str(tmp_path / "out" / "tables"), "stats/message").count() == 26
