"""The nested round trip on the driver tables against its flat DuckDB twins."""

from __future__ import annotations

import json
from pathlib import Path

import duckdb
import pytest

from parley.oracle.roundtrip import oracle_sql
from parley.plans import roundtrip
from parley.sources import load_metrics

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(roundtrip.QUERIES))
def test_matches_flat_sql(spark, key):
    con = duckdb.connect()
    for name in ("conversations", "events", "documents", "customer", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(oracle_sql()[key])
    names = [c[0] for c in want.description]
    got = roundtrip.QUERIES[key](spark, SF)
    assert got.columns == names and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_nested_values_are_bounded_json(spark):
    conversations, projects, _ = roundtrip.nested(spark, SF)
    for r in conversations.collect():
        c = json.loads(r.value)
        assert 1 <= len(c["chat_messages"]) <= roundtrip.TURNS and all(m["content"] for m in c["chat_messages"])
    assert max(len(json.loads(r.value)["docs"]) for r in projects.collect()) <= roundtrip.DOCS


def _size(paths) -> int:
    return sum(p.stat().st_size for p in paths)


def test_export_and_tables_are_written_small(spark):
    """JSON parts and tables are compressed, and blocks go to their folders without a sort of whole rows."""
    tables = roundtrip.tables(spark, SF)
    text = sum(len(r.value) for df in roundtrip.nested(spark, SF)[:2] for r in df.collect())
    written = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "parley"
    parts = [max(written.glob(f"nested-*/{name}"), key=lambda p: p.stat().st_mtime) for name in ("conversations", "projects")]
    assert 3 * _size(f for p in parts if "staged" not in str(p) for f in p.glob("part-*")) < text
    assert all(f.endswith(".zstd.parquet") for t in (tables.messages, tables.blocks, tables.docs) for f in t.inputFiles())


def test_calls_are_shuffled_as_columns(spark):
    """What the grouping exchanges of a call is columns, not its JSON text."""
    plan = roundtrip.nested(spark, SF)[0]._jdf.queryExecution().sparkPlan().toString()
    assert "tool_use" not in plan[plan.index("partial_collect_list"):]


def test_blocks_are_written_without_a_sort(spark, tmp_path):
    before = spark.conf.get(load_metrics.OPEN_FILES, None)
    with load_metrics.unsorted(spark):
        assert spark.conf.get(load_metrics.OPEN_FILES) == str(load_metrics.FOLDERS)
    assert spark.conf.get(load_metrics.OPEN_FILES, None) == before
    types = [f"t{i % 40}" for i in range(200)]  # more folders than are open at a time
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(types)], "block_id string, type string")
    back = load_metrics.LoadMetrics().write("blocks", df, str(tmp_path / "blocks"), ["type"])
    assert sorted(map(tuple, back.collect())) == sorted((str(i), t) for i, t in enumerate(types))


def test_events_with_missing_and_repeated_keys(spark, tmp_path):
    """Calls in order of id, ties by their JSON, rows without an id together."""
    for name in ("conversations", "documents", "customer"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    (spark.read.parquet(f"{SF}/events.parquet").limit(0).unionByName(spark.createDataFrame(
        [(9, "b", 1.0, '{"k": 1}'), (9, "a", 0.5, None), (8, None, None, "x"), (None, "a", 2.0, "{}")],
        "event_id long, event_type string, value double, props string"), allowMissingColumns=True)
     .write.parquet(str(tmp_path / "events.parquet")))
    found = {c.get("uuid"): c["chat_messages"] for c in (json.loads(r.value) for r in roundtrip.nested(spark, str(tmp_path))[0].collect())}
    assert [m["content"][0]["name"] for m in found[None]] == ["a"]
    calls = [(m["uuid"], m["content"][0].get("name"), m["content"][0].get("input")) for m in found["e1"]]
    assert calls == [("e8", None, {}), ("e9", "a", None), ("e9", "b", {"k": 1})]
