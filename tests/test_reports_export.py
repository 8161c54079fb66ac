"""Report modules on the nested export fixture: export-only reports and hand-computed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.plans import REGISTRY
from tests.conftest import one, rows


def run(ctx, key):
    return REGISTRY[key][1](ctx)


def test_voice_notes(jctx):
    assert one(run(jctx, "m02_voice_notes")) == {"voice_note_messages": 1}


def test_message_text_and_tokens(jctx):
    t = {r["message_uuid"]: r for r in run(jctx, "message_tokens").collect()}
    # 43 chars of concatenated text -> 10 tokens; one fenced body "print(1)\n" -> 9 chars, 2 tokens
    assert (t["a1"]["tokens_text"], t["a1"]["chars_code"], t["a1"]["tokens_code"]) == (10, 9, 2)
    assert t["a3"]["chars_code"] == len("let a = 1;\n")  # unterminated fence runs to the end
    assert t["f9"]["tokens_text"] == 0


def test_code_blocks_and_languages(jctx):
    cb = rows(run(jctx, "code_blocks"), "message_uuid", "position", "language", "chars")
    assert cb == [("a1", 0, "python", 9), ("a3", 0, "js", 11), ("b3", 0, "", 3)]
    langs = rows(run(jctx, "m10_languages"), "language", "blocks")
    assert langs == [("(empty)", 1), ("javascript", 1), ("python", 1)]


def test_inline_code_spans(jctx):
    inl = dict(rows(run(jctx, "inline_code_count"), "message_uuid", "inline_code_count"))
    assert inl["a0"] == 1  # `x` counts; ``y`` and ```z``` do not


def test_attachment_types_and_sizes(jctx):
    assert rows(run(jctx, "m07_top_types"), "file_type", "n") == [("(unknown)", 2), ("txt", 1)]
    s = one(run(jctx, "m07_size"))
    assert (s["n"], s["p50"], s["max"], s["min"]) == (3, 2048.0, 4096.0, 500.0)
    assert rows(run(jctx, "m07_size_buckets"), "bucket_index", "n")[:2] == [(0, 1), (1, 2)]
    ts = {r["file_type"]: r for r in run(jctx, "m07_type_size").collect()}
    assert (ts["(unknown)"]["n"], ts["(unknown)"]["size_p50"], ts["(unknown)"]["size_p95"]) == (2, 3072.0, 3993.6)
    assert rows(run(jctx, "m07_type_monthly"), "month", "file_type", "n") == [
        ("2024-03", "(unknown)", 2), ("2024-03", "txt", 1)]


def test_attachment_fanout_flag(spark, export_tables):
    from parley.config import Config
    from parley.plans.base import context_for_tables

    plain = context_for_tables(spark, export_tables, Config(tz="UTC"))
    fan = context_for_tables(spark, export_tables, Config(tz="UTC", fanout_m07=True))
    assert rows(run(plain, "m07_monthly")) == [("2024-03", 3, 3)]
    # a0 carries 2 attachments and 3 files: joining both sides at once gives 2 x 3 rows
    assert rows(run(fan, "m07_monthly")) == [("2024-03", 7, 6)]


def test_artifacts(jctx):
    assert rows(run(jctx, "m09_types"), "type_label", "n") == [("(untyped)", 1), ("code", 1), ("markdown", 1)]
    assert rows(run(jctx, "m09_commands"), "command", "n") == [("(none)", 1), ("create", 1), ("update", 1)]
    it = one(run(jctx, "m09_iteration"))
    assert (it["create"], it["update"], it["iteration_ratio"]) == (1, 1, 1.0)
    assert rows(run(jctx, "m09_languages"), "language", "n", "pct") == [("python", 1, 100.0)]
    assert one(run(jctx, "m09_content_len"))["n"] == 2
    tc = {r["type_label"]: r for r in run(jctx, "m09_type_command").collect()}
    assert (tc["code"]["create"], tc["(untyped)"]["update"], tc["markdown"]["total"]) == (1, 1, 0)


def test_citations(jctx):
    t = one(run(jctx, "m11_totals"))
    # '' (url without scheme) is a domain value, NULL is not
    assert t == {"citations": 3, "messages": 1, "conversations": 1, "domains": 2, "urls": 2}
    assert rows(run(jctx, "m11_monthly")) == [("2024-03", 3, 1)]
    assert rows(run(jctx, "m11_domains"), "domain", "citations") == [("example.com", 1)]


def test_post_error_outcomes(jctx):
    got = rows(run(jctx, "m12_post_error"), "outcome", "n", "pct")
    assert got == sorted([(k, 1, 20.0) for k in
                          ["retry_same_tool", "diff_tool", "no_tool", "ended_on_human", "no_followup"]])


def test_error_messages_and_categories(jctx):
    assert run(jctx, "m12_error_messages").count() == 4  # the empty-content error drops out
    assert rows(run(jctx, "m12_categories"), "category", "n") == [("NOT_FOUND", 2), ("PERMISSIONS", 1),
                                                                  ("TIMEOUT", 1)]
    norm = {r["message_uuid"]: r["normalized"] for r in run(jctx, "m12_normalize").collect()}
    assert norm["b1"] == "File not found: <PATH>"


def test_highlight_rule_without_eligible_tools(jctx):
    h = {r["kind"]: r for r in run(jctx, "m12_highlight_tools").collect()}
    # no tool reaches 20 calls: the rule falls back to the first tool by errors (ties by name)
    assert h["highest_rate_by_count"]["name"] == "filesystem:read_file"
    assert "highest_rate" not in h


def test_forks_and_branches(jctx):
    t = one(run(jctx, "m13_totals"))
    assert (t["human_fork_points"], t["assistant_fork_points"], t["inplace_edits"]) == (1, 0, 1)
    assert t["multi_root_conversations"] == 1 and t["nonempty_conversations"] == 6
    assert one(run(jctx, "m13_extra_children")) == {"extra_children_human_fork": 2,
                                                     "extra_children_assistant_fork": 0}
    b = {r["kind"]: r for r in run(jctx, "m13_branch_continued").collect()}["human_fork"]
    assert (b["first_continued"], b["last_continued"], b["middle_continued"], b["continued"], b["children"]) == \
        (0, 0, 1, 1, 3)
    d = {r["kind"]: r for r in run(jctx, "m13_len_delta").collect()}["human_fork"]
    assert (d["n"], d["first_p50"], d["last_p50"], d["shortened"]) == (1, 6.0, 2.0, 1)


def test_inplace_threshold_is_strict(jctx):
    f = dict(rows(run(jctx, "inplace_edit"), "message_uuid", "inplace_edit_flag"))
    assert f["a1"] is False and f["a2"] is True  # 60 s is not an edit, 61 s is


def test_roots_null_and_sentinel(jctx):
    rc = dict(rows(run(jctx, "root_sender_forks"), "conversation_uuid", "root_count"))
    assert rc["c-f"] == 2 and rc["c-g"] == 0


def test_overview_blocks_and_durations(jctx):
    blocks = dict(rows(run(jctx, "overview_blocks"), "type", "n"))
    assert blocks["tool_use"] == 11 and blocks["voice_note"] == 1 and blocks["token_budget"] == 1
    d = one(run(jctx, "m05_duration"))
    assert (d["n"], d["p50"]) == (2, 1.5)
    cats = dict(rows(run(jctx, "m05_categories"), "category", "calls"))
    assert cats == {"file write": 0, "file read": 2, "execute": 1, "web": 3, "artifact": 4, "directory": 0,
                    "search": 1, "other": 0}


def test_every_module_runs_on_export(jctx):
    from parley.plans.base import run_module

    for module in sorted({m for m, _ in REGISTRY.values()}):
        for key, df in run_module(module, jctx).items():
            assert df.count() >= 0, key


def test_empty_population_gives_n0_and_nulls(jctx):
    s = one(run(jctx, "m12_compare").where(F.col("cohort") == "without_errors").where(F.col("metric") == "tool_calls"))
    assert s["n"] == 1 and s["p50"] is not None
    e = one(run(jctx, "m13_fork_per_convo").where(F.col("kind") == "assistant_fork"))
    assert e["n"] == 0 and e["p50"] is None and e["mean"] is None
