"""E1-E14 on the hand-written nested export (expected values computed by hand)."""

from __future__ import annotations

import json
import os

import pytest

from parley.sources import export
from tests.conftest import FIXTURES, one, rows


def test_find_export_any_depth(spark):
    p = export.find_export(spark, os.path.join(FIXTURES, "export"))
    assert p["conversations.json"].endswith("export/nested/dir/conversations.json")
    assert p["projects.json"].endswith("export/nested/projects.json")
    assert p["users.json"].endswith("export/users.json")


def test_find_export_missing_file(spark, tmp_path):
    (tmp_path / "conversations.json").write_text("[]")
    with pytest.raises(FileNotFoundError):
        export.find_export(spark, str(tmp_path))


def test_load_counts(export_tables):
    got = dict(rows(export.load_counts(export_tables)))
    assert got == {"users": 2, "projects": 3, "docs": 2, "conversations": 8, "messages": 26, "blocks": 42,
                   "tool_calls": 11, "tool_results": 5, "attachments": 3, "files": 3}


def test_conversations_message_count_null_array(export_tables):
    got = dict(rows(export_tables.conversations, "conversation_uuid", "message_count"))
    assert got["c-g"] == 0 and got["c-h"] == 0 and got["c-f"] == 7


def test_messages_text_concat_and_counts(export_tables):
    m = {r["message_uuid"]: r for r in export_tables.messages.collect()}
    # two text blocks joined by a newline in block order; chars are the sum of block lengths
    assert m["a1"]["text"] == "Here:\n```python\nprint(1)\n```\nok\nsecond part"
    assert m["a1"]["chars_text"] == 31 + 11 and m["a1"]["thinking"] == "let me think"
    assert m["a4"]["text"] == "spoken words"  # voice notes count as text
    assert m["b1"]["text"] == "" and m["b1"]["chars_text"] == 0  # tool-only message
    assert m["f9"]["text"] == "" and m["f9"]["chars_text"] == 0
    assert (m["a0"]["attachment_count"], m["a0"]["file_count"]) == (2, 3)
    assert m["a0"]["position"] == 0 and m["f9"]["position"] == 6


def test_blocks(export_tables):
    b = {r["block_id"]: r for r in export_tables.blocks.collect()}
    assert b["b1#2"]["type"] == "token_budget" and b["b1#2"]["text_length"] is None
    assert b["a1#0"]["text_length"] == 12  # thinking text
    assert b["a3#0"]["raw"].startswith("{") and '"tool_use"' in b["a3#0"]["raw"]
    types = {r["type"] for r in b.values()}
    assert types == {"text", "thinking", "tool_use", "tool_result", "token_budget", "voice_note"}


def test_tool_calls_and_results(export_tables):
    tc = {r["block_id"]: r for r in export_tables.tool_calls.collect()}
    assert tc["a3#0"]["duration_s"] == 2.0 and tc["a5#0"]["duration_s"] is None
    assert tc["b1#0"]["name"] == "filesystem:read_file"
    tr = {r["block_id"]: r for r in export_tables.tool_results.collect()}
    assert tr["c1#1"]["texts"] == [] and tr["a3#1"]["texts"] == ["HTTP 403 forbidden"]


def test_citations(export_tables):
    got = rows(export_tables.citations, "cite_type", "url", "domain")
    # no scheme -> '' (no match); NULL url -> NULL
    assert got == [("doc", "example.org/x", ""), ("web_search_citation", "https://example.com/a", "example.com"),
                   ("web_search_citation", None, None)]


def test_projects_docs_users(export_tables):
    p = {r["project_uuid"]: r for r in export_tables.projects.collect()}
    assert p["p-2"]["creator_uuid"] is None and p["p-1"]["creator_full_name"] == "User One"
    d = {r["doc_uuid"]: r for r in export_tables.docs.collect()}
    assert d["d-2"]["content"] == "" and d["d-2"]["content_length"] == 0 and d["d-1"]["content_length"] == 3
    assert export_tables.users.count() == 2


def test_attachments_files(export_tables):
    a = rows(export_tables.attachments, "message_uuid", "position", "file_type", "content_length")
    assert a == [("a0", 0, "txt", 3), ("a0", 1, "", 0), ("b0", 0, None, 3)]
    assert export_tables.files.count() == 3


def test_keys_valid_and_consistent(export_tables):
    assert export.key_violations(export_tables).count() == 0
    export.validate(export_tables)
    c = one(export.consistency(export_tables))
    assert c == {"tool_use_blocks": 11, "tool_calls": 11, "consistent": True}


def test_duplicate_message_uuid_rejected(spark):
    t = export.load_dir(spark, os.path.join(FIXTURES, "bad"))
    bad = rows(export.key_violations(t), "table", "key", "problem")
    assert ("messages", "dup", "duplicate key") in bad
    with pytest.raises(ValueError):
        export.validate(t)


def test_staged_load_equals_direct(spark, export_tables, tmp_path):
    staged = export.load_dir(spark, os.path.join(FIXTURES, "export"), stage_dir=str(tmp_path / "stage"))
    for name in ("conversations", "messages", "tool_calls", "tool_results", "citations", "attachments", "files"):
        a, b = getattr(staged, name), getattr(export_tables, name)
        assert rows(a.drop(*[c for c in a.columns if c in ("raw",)])) == rows(b.drop(*[c for c in b.columns
                                                                                       if c in ("raw",)])), name


def test_context_for_export_materialised(spark):
    from parley.plans import REGISTRY
    from parley.plans.base import context_for_export

    ctx = context_for_export(spark, os.path.join(FIXTURES, "export"))
    assert ctx.materialized
    got = rows(REGISTRY["m12_post_error"][1](ctx), "outcome", "n")
    assert [n for _, n in got] == [1, 1, 1, 1, 1]


def test_json_lines_input_equals_array_input(spark, export_tables, tmp_path):
    import json

    src = os.path.join(FIXTURES, "export")
    p = export.find_export(spark, src)
    for name, path in p.items():
        arr = json.load(open(path.replace("file:", ""), encoding="utf-8"))
        with open(tmp_path / name, "w", encoding="utf-8") as f:
            for item in arr:
                f.write(json.dumps(item) + "\n")
    t = export.load_dir(spark, str(tmp_path), multiline=False)
    for name in ("conversations", "messages", "tool_calls", "citations", "attachments", "files", "projects", "docs"):
        assert rows(getattr(t, name).drop("raw")) == rows(getattr(export_tables, name).drop("raw")), name


def test_export_as_folders_of_json_lines_parts(spark, export_tables, tmp_path):
    import json

    p = export.find_export(spark, os.path.join(FIXTURES, "export"))
    for name, path in p.items():
        arr = json.load(open(path.replace("file:", ""), encoding="utf-8"))
        d = tmp_path / "big" / name.rsplit(".", 1)[0]
        d.mkdir(parents=True)
        for part in range(2):
            with open(d / f"part-{part}.json", "w", encoding="utf-8") as f:
                for item in arr[part::2]:
                    f.write(json.dumps(item) + "\n")
    found = export.find_export(spark, str(tmp_path / "big"))
    assert found["conversations.json"].endswith("/big/conversations")
    t = export.load_dir(spark, str(tmp_path / "big"), multiline=False)
    assert rows(t.messages.drop("raw")) == rows(export_tables.messages.drop("raw"))


def test_empty_export_fails_sanity(spark, tmp_path):
    from parley.plans.base import context_for_export

    for name in ("conversations", "projects", "users"):
        (tmp_path / f"{name}.json").write_text("[]")
    with pytest.raises(ValueError):
        context_for_export(spark, str(tmp_path))


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def _small_export(root, conversations, name="conversations.json"):
    _write(f"{root}/{name}", conversations)
    _write(f"{root}/projects.json", "[]")
    _write(f"{root}/users.json", "[]")


def _conversation(i, message):
    return json.dumps({"uuid": f"c{i}", "name": "n", "chat_messages": [{"uuid": message, "text": "x", "sender": "human", "content": []}]})


def test_json_lines_are_read_line_by_line_by_default(spark, tmp_path):
    lines = "\n".join(_conversation(i, f"m{i}") for i in range(5))
    _small_export(tmp_path / "a", lines, "conversations.jsonl")
    assert export.load_dir(spark, str(tmp_path / "a")).conversations.count() == 5
    _small_export(tmp_path / "b", lines, "conversations/part-0.json")
    assert export.load_dir(spark, str(tmp_path / "b")).conversations.count() == 5


def test_malformed_records_and_repeated_keys_fail(spark, tmp_path):
    from parley.plans.base import context_for_export

    _small_export(tmp_path / "a", _conversation(1, "m1") + "\n{broken\n", "conversations.jsonl")
    with pytest.raises(Exception, match="(?i)malformed"):
        export.load_dir(spark, str(tmp_path / "a")).conversations.collect()
    _small_export(tmp_path / "b", "[" + _conversation(1, "m1") + "," + _conversation(2, "m1") + "]")
    with pytest.raises(ValueError, match="messages:m1"):
        context_for_export(spark, str(tmp_path / "b"))


def test_export_is_found_by_depth(spark, tmp_path):
    _small_export(tmp_path / "a_very_long_folder_name_for_an_export", "[]")
    _write(f"{tmp_path}/a/b/c/conversations.json", "[]")
    assert export.find_export(spark, str(tmp_path))["conversations.json"].endswith("a_very_long_folder_name_for_an_export/conversations.json")
