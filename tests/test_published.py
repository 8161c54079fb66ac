"""Figures taken while writing (E11-E13) and tables published as a whole."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from parley.plans import base
from parley.plans.base import context_for_export, materialize_tables
from parley.sources import export, published
from parley.sources.load_metrics import LoadMetrics
from tests.conftest import FIXTURES, one, rows

EXPORT = os.path.join(FIXTURES, "export")


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_figures_of_the_write_equal_counted_ones(spark, export_tables, tmp_path):
    m = LoadMetrics()
    t = materialize_tables(spark, export_tables, base=str(tmp_path), metrics=m)
    assert rows(m.counts(spark)) == rows(export.load_counts(t))
    assert one(m.consistency(spark)) == one(export.consistency(t))
    assert m.figures["citations"]["rows"] == t.citations.count()
    m.check()


def test_figures_of_empty_tables_and_missing_keys(spark, export_tables, tmp_path):
    m = LoadMetrics()
    none = m.write("users", export_tables.users.where("false"), str(tmp_path / "a"))
    assert none.count() == 0 and m.figures["users"] == {"rows": 0, "bare": 0, "tool_use": 0}
    m.write("users", spark.createDataFrame([], "uuid string"), str(tmp_path / "b"))
    assert m.figures["users"]["rows"] == 0
    m.write("docs", export_tables.docs.withColumn("doc_uuid", F.lit(None).cast("string")), str(tmp_path / "c"))
    assert m.figures["docs"]["bare"] == 2
    with pytest.raises(ValueError, match="docs: 2 rows"):
        m.check()


def test_blocks_without_their_calls_are_told(spark, export_tables, tmp_path):
    m = LoadMetrics()
    m.write("blocks", export_tables.blocks, str(tmp_path / "b"), ["type"])
    m.write("tool_calls", export_tables.tool_calls.where("block_id <> 'a3#0'"), str(tmp_path / "c"))
    assert one(m.consistency(spark)) == {"tool_use_blocks": 11, "tool_calls": 10, "consistent": False}
    with pytest.raises(ValueError, match="differ"):
        m.check()


def test_keys_of_all_tables_take_one_exchange(spark, export_tables, tmp_path):
    from dataclasses import replace

    export_tables = materialize_tables(spark, export_tables, base=str(tmp_path))
    assert _exchanges(export.key_violations(export_tables)) == 1
    # equal keys of different tables are no repetition; repeated and missing ones are told with their number
    t = replace(export_tables, users=export_tables.users.unionByName(export_tables.users),
                docs=export_tables.docs.withColumn("doc_uuid", F.lit(None).cast("string")))
    got = rows(export.key_violations(t), "table", "n", "problem")
    assert got == [("docs", 2, "missing key"), ("users", 2, "duplicate key"), ("users", 2, "duplicate key")]


def test_a_load_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tables")
    assert published.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        published.table(spark, root, "messages")
    context_for_export(spark, EXPORT, tables_dir=root)
    first = published.current(spark, root)
    assert first.seq == 1 and first.tables["messages"][0] == 26 and "stats/message" in first.tables
    held = published.table(spark, root, "messages")

    whole = LoadMetrics.write

    def dies(self, name, df, path, partition_by=None):  # messages and conversations are written, calls are not
        if name == "tool_calls":
            raise OSError("lost")
        return whole(self, name, df.limit(1), path, partition_by)

    with monkeypatch.context() as m:
        m.setattr(base.LoadMetrics, "write", dies)
        with pytest.raises(OSError):
            context_for_export(spark, EXPORT, tables_dir=root)
    assert published.current(spark, root) == first
    assert published.table(spark, root, "messages").count() == 26

    context_for_export(spark, EXPORT, tables_dir=root)
    second = published.current(spark, root)
    assert second.seq == 2 and second.name != first.name
    assert held.count() == 26 and published.table(spark, root, "messages", first).count() == 26
    assert rows(published.table(spark, root, "blocks").drop("raw")) == rows(published.table(spark, root, "blocks", first).drop("raw"))
    with pytest.raises(KeyError):
        published.table(spark, root, "nothing")


def test_a_load_that_fails_its_checks_is_not_published(spark, tmp_path):
    root = str(tmp_path / "tables")
    with pytest.raises(ValueError):
        context_for_export(spark, os.path.join(FIXTURES, "bad"), tables_dir=root)
    assert published.current(spark, root) is None
