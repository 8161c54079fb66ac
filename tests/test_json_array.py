"""The splittable array reader against Python's json and against Spark's own reader."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from parley.sources import export, json_array
from tests.conftest import FIXTURES


@pytest.fixture
def ranges(spark):
    """Byte ranges of the given size."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    def cut(n):
        for k, v in zip(keys, (str(n), "0", "1")):
            spark.conf.set(k, v)
    yield cut
    for k in keys:
        spark.conf.unset(k)


ODD = ['}{][', 'a "quoted" }', 'back\\slash \\" }', "}\n]", '{"chat_messages": [{"x": 1}]}', "é🙂}", "", "\\", '"', '\\\\"}']


def made(rng, n=12):
    def text():
        return "".join(rng.choice(ODD) for _ in range(rng.randint(0, 3)))

    def message(i):
        return {"uuid": f"m{i}", "text": text(), "content": [{"type": "text", "text": text(), "input": {"chat_messages": [{"y": [1, {}]}]}}], "attachments": [], "files": []}

    out = []
    for i in range(n):
        c = {"uuid": f"c{i}", "name": text(), "account": {"uuid": "a}"}, "chat_messages": [message(j) for j in range(rng.randint(0, 5))], "summary": text()}
        if i % 5 == 1:
            c["chat_messages"] = None
        if i % 5 == 2:
            del c["chat_messages"]
        if i % 5 == 3:
            c = dict(reversed(c.items()))
        if i % 7 == 6:
            c["tags"] = ["}", 3, []]
        out.append(c)
    out[4]["chat_messages"] = [message(j) for j in range(40)]  # a large share of the file
    return out


@pytest.mark.parametrize("size, layout", [(400, {}), (900, {"indent": 2}), (777, {"ensure_ascii": False, "separators": (",", ":")})])
def test_frames_equal_json(spark, ranges, tmp_path, size, layout):
    rows = made(random.Random(size))
    (tmp_path / "x.json").write_text("\n " + json.dumps(rows, **layout) + "\n")
    ranges(size)
    got = json_array.records(spark, str(tmp_path / "x.json"), str(tmp_path / "s1"))
    assert [json.loads(r.text) for r in sorted(got.collect(), key=lambda r: r.record)] == rows
    whole, elements = json_array.nested_records(spark, str(tmp_path / "x.json"), "chat_messages", str(tmp_path / "s2"))
    assert spark.read.parquet(str(tmp_path / "s2" / "pieces")).select("block").distinct().count() > 5
    whole = sorted(whole.collect(), key=lambda r: r.record)
    assert [{**json.loads(r.text), "chat_messages": 0} for r in whole] == [{**c, "chat_messages": 0} for c in rows]
    assert [r.elements for r in whole] == [len(c.get("chat_messages") or []) for c in rows]
    found = sorted((r.record, r.position, json.loads(r.text)["uuid"], json.loads(r.text)["text"]) for r in elements.collect())
    assert found == [(i, j, m["uuid"], m["text"]) for i, c in enumerate(rows) for j, m in enumerate(c.get("chat_messages") or [])]


@pytest.mark.parametrize("text, n", [("[]", 0), (" [ ] \n", 0), ("[{}]", 1), ('[{"a":1},\n{"a":"]"}]', 2)])
def test_small_arrays(spark, tmp_path, text, n):
    (tmp_path / "x.json").write_text(text)
    assert json_array.is_array(spark, str(tmp_path / "x.json"))
    assert json_array.records(spark, str(tmp_path / "x.json"), str(tmp_path / "s")).count() == n


@pytest.mark.parametrize("text", ['[{"a":1},{"a":', '[{"a":1}', '[{"a":1},', '[{"a":"x}]', '[{"a":1}]]'])
def test_cut_off_files_fail(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="does not end as one"):
        json_array.records(spark, str(tmp_path / "x.json"), str(tmp_path / "s")).collect()


def test_other_arrays_of_objects_fail(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"uuid": "a", "other": [{"b": 1}], "chat_messages": [{"c": 1}]}]')
    with pytest.raises(Exception, match="other than chat_messages"):
        json_array.nested_records(spark, str(tmp_path / "x.json"), "chat_messages", str(tmp_path / "s"))


def values(df):
    """Rows; block texts as JSON values, since framed ones keep no spaces between tokens."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(str({k: json.loads(v) if k == "raw" else v for k, v in r.items()}) for r in rows)


def test_export_tables_equal_spark_reader(spark, ranges, tmp_path):
    """The nested fixture, and one whose middle conversation is most of the file, in ranges of 1,000 bytes."""
    (tmp_path / "conversations.json").write_text(json.dumps(made(random.Random(1), 9)))
    fixture = export.find_export(spark, os.path.join(FIXTURES, "export"))["conversations.json"]
    for path in (str(tmp_path / "conversations.json"), fixture):
        ranges(1000)
        mine = export.load(spark, path)
        ranges(1 << 27)
        theirs = export.load(spark, path, multiline=True)
        for name in ("conversations", "messages", "blocks", "tool_calls", "tool_results", "citations", "attachments", "files"):
            a, b = getattr(mine, name), getattr(theirs, name)
            assert a.schema == b.schema or a.dtypes == b.dtypes, name
            assert values(a) == values(b), name


def test_a_parsers_filter_meets_elements_only(spark, tmp_path):
    """A filter on the parsed element that is pushed to the units keeps the text of other units from the parser."""
    (tmp_path / "a.json").write_text('[{"id": 1, "ms": [{"x": 1}, {"x": 2}], "t": {"u": 2}}, {"id": 2, "ms": [{"x": 3}]}]')
    elements = json_array.nested_records(spark, str(tmp_path / "a.json"), "ms", str(tmp_path / "scratch"))[1]
    x = F.from_json("text", "x INT", {"mode": "FAILFAST"})["x"]
    found = elements.where(x > 1)
    filters = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line and "from_json" in line]
    assert filters and all("CASE WHEN (after#" in line for line in filters)
    assert sorted((r.record, r.position, r.text) for r in found.collect()) == [(0, 1, '{"x": 2}'), (1, 0, '{"x": 3}')]
