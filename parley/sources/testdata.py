"""Adapters that reshape the driver test tables into the chat data model.

The driver tables (`conversations`, `events`, `documents`, `pages`) carry no timestamps,
tree, tools, blocks or attachments, so the adapters derive them by fixed arithmetic (the rules are
spelled out in FIXTURES.md; the DuckDB oracle uses the same rules as SQL text). All of it is
column expressions on the scans, so predicates and pruning still reach parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.config import SENTINEL_ROOT
from parley.sources.tables import Tables

# Fixed values of the test-view rules (FIXTURES.md).
EPOCH_BASE = 1704067200
VT_TOOL_NAMES = [
    "web_search", "web_fetch", "filesystem:write_file", "bash_tool", "view",
    "artifacts", "grep", "list_directory", "custom:x",
]
VT_ERROR_TEXTS = [
    "File not found: /tmp/a.txt", "HTTP 403 forbidden", "Request timed out",
    "429 Too Many Requests", "blocked by robots.txt", "client_error: https://a.b/c",
    "validation failed", "No result received", "parse error", "unknown error", "boom",
]
VM_CODE_TAGS = ["python", "py", "JS ", "", "bash x"]
VA_FILE_TYPES = ["txt", "application/pdf", "", "image/png", "text/csv", "md", "json", "py", "html", None]
VT_ARTIFACT_TYPES = ["text/markdown", "application/vnd.ant.code", "application/vnd.ant.react", "image/svg+xml", "text/html", "x/other", ""]
VT_ARTIFACT_COMMANDS = ["create", "update", "rewrite", ""]
VT_ARTIFACT_LANGUAGES = ["python", "javascript", "", "sql", "rust"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list[str]) -> Column:
    """values[index] as a CASE chain (JVM expression, no lookup table)."""
    expr = None
    for i, v in enumerate(values[:-1]):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


def vm_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    conv, turn, role, text = F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")
    sconv = conv.cast("string")

    def mid(t: Column) -> Column:
        return F.concat(sconv, F.lit("#"), t.cast("string"))

    parent = (
        F.when(turn == 0, F.lit(SENTINEL_ROOT))
        .when((turn == 5) & (conv % 12 == 0), F.lit(None).cast("string"))
        .when((turn >= 3) & ((conv + turn) % 5 == 0), mid(turn - 3))
        .otherwise(mid(turn - 1))
    )
    created_s = (
        F.lit(EPOCH_BASE) + conv * 26000 + (conv % 14) * 2592000 + turn * 900 + (conv * 17 + turn * 131) % 880
        + F.when((conv % 10 == 0) & (turn >= 4), F.lit(90000)).otherwise(F.lit(0))
    )
    edit_s = (
        F.when((conv + turn) % 9 == 0, 61 + (conv * 7919 + turn * 104729) % 700000)
        .otherwise((conv + turn) % 5)
    )
    fence = F.lit("```")
    nl = F.lit("\n")
    msg_text = (
        F.when(
            (role == "assistant") & ((conv + turn) % 3 == 0),
            F.concat(text, nl, fence, _pick(conv % 5, VM_CODE_TAGS), nl,
                     F.substring(text, 1, 200), nl, fence, nl, F.lit("see `x`")),
        ).otherwise(text)
    )
    thinking = (
        F.when((role == "assistant") & (conv % 4 == 0),
               F.expr("substr(text, 1, CAST((conv_id * turn) % 400 AS INT))"))
        .otherwise(F.lit(""))
    )
    return c.select(
        mid(turn).alias("message_uuid"),
        sconv.alias("conversation_uuid"),
        parent.alias("parent_message_uuid"),
        F.when(role == "user", F.lit("human")).otherwise(role).alias("sender"),
        turn.cast("int").alias("position"),
        F.timestamp_seconds(created_s).alias("created_at"),
        F.timestamp_seconds(created_s + edit_s).alias("updated_at"),
        msg_text.alias("text"),
        thinking.alias("thinking"),
        F.when((role == "user") & (conv % 6 == 0), 1 + conv % 3).otherwise(0).cast("int").alias("attachment_count"),
        F.when((role == "user") & (conv % 8 == 0), 1 + conv % 2).otherwise(0).cast("int").alias("file_count"),
    ).select(
        "*",
        F.length("text").cast("long").alias("chars_text"),
        F.length("thinking").cast("long").alias("chars_thinking"),
    )


def vt_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.col("event_id")
    # an artifact call holds a JSON object, one in eight the event's props, one no JSON at all
    artifact = F.concat(F.lit('{"type":"'), _pick(event % 7, VT_ARTIFACT_TYPES),
                        F.lit('","command":"'), _pick(event % 4, VT_ARTIFACT_COMMANDS),
                        F.lit('","language":"'), _pick(event % 5, VT_ARTIFACT_LANGUAGES),
                        F.lit('","content":"'), F.expr("repeat('x', CAST((event_id * 37) % 9000 AS INT))"), F.lit('"}'))
    props = (F.when((k % 9 != 5) | (event % 8 == 0), F.col("props")).when(event % 8 == 1, F.lit("not json {"))
             .otherwise(artifact))
    uid = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id"),
        uid.alias("conversation_uuid"),
        F.concat(uid, F.lit("#"), (1 + F.col("event_id") % 8).cast("string")).alias("message_uuid"),
        _pick(k % 9, VT_TOOL_NAMES).alias("name"),
        (F.col("event_type") == "error").alias("is_error"),
        # parquet stores a UTC wall clock without zone (TIMESTAMP_NTZ); sessions run in UTC
        F.col("ts").cast("timestamp").alias("start_timestamp"),
        F.col("value").alias("duration_s"),
        _pick(k % 11, VT_ERROR_TEXTS).alias("error_text"),
        props.alias("input"),
    )


def vconv(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = (
        _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))
        .union(_read(spark, sf_dir, "events").select(F.col("user_id").alias("id")))
        .distinct()
    )
    return ids.select(
        F.col("id").cast("string").alias("conversation_uuid"),
        F.concat(F.lit("conv "), (F.col("id") % 37).cast("string")).alias("name"),
    )


def vd_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("doc_uuid"),
        F.col("source").alias("project_uuid"),
        F.length("text").cast("long").alias("content_length"),
    )


def vd_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    g = d.groupBy("source").agg(F.min("doc_id").alias("m"))
    m = F.col("m")
    return g.select(
        F.col("source").alias("project_uuid"),
        F.col("source").alias("name"),
        F.when(m % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("about "), F.col("source"))).alias("description"),
        F.when(m % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.expr("repeat('p', CAST((m * 311) % 6000 AS INT))")).alias("prompt_template"),
        (m % 2 == 0).alias("is_private"),
        (m % 7 == 0).alias("is_starter_project"),
        F.timestamp_seconds(F.lit(EPOCH_BASE) + m * 900000).alias("created_at"),
    )


def vc_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    cid = (F.col("page_id") % 40).cast("string")
    return p.select(
        cid.alias("conversation_uuid"),
        F.concat(cid, F.lit("#"), (1 + F.col("page_id") % 4).cast("string")).alias("message_uuid"),
        F.lit("web_search_citation").alias("cite_type"),
        F.col("url"),
        F.regexp_extract("url", r"https?://([^/]+)", 1).alias("domain"),
        F.when(F.col("page_id") % 10 != 0, F.timestamp_seconds(F.lit(EPOCH_BASE) + F.col("page_id") * 259200)).alias("cited_at"),
    )


def va_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows a message as its attachment_count; one in seven has no size."""
    c = _read(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.col("conv_id") % 6 == 0))
    a = c.select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.col("conv_id") % 3)).alias("position"))
    x = F.col("conv_id") * 7919 + F.col("turn") * 104729 + F.col("position") * 31
    size = _pick(x % 7, [None, 1000, 10000, 100000, 1000000, 5000000, 10])
    return a.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string")).alias("message_uuid"),
        F.col("position").cast("int").alias("position"),
        F.concat(F.lit("f"), F.col("position").cast("string")).alias("file_name"),
        (x % size).cast("long").alias("file_size"),
        _pick(x % 10, VA_FILE_TYPES).alias("file_type"))


def vb_blocks(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """A block a kind of content that a message or a tool event has."""
    voice = (F.col("sender") == "human") & (F.col("conversation_uuid").cast("long") % 11 == 3)
    kinds = F.array_compact(F.array(
        F.when(F.col("chars_thinking") > 0, F.lit("thinking")),
        F.when(F.col("chars_text") > 0, F.when(voice, F.lit("voice_note")).otherwise(F.lit("text")))))
    said = messages.select("message_uuid", F.posexplode(kinds).alias("position", "type"))
    return said.unionByName(tools.select(
        "message_uuid", F.posexplode(F.array(F.lit("tool_use"), F.lit("tool_result"))).alias("position", "type")))


def load(spark: SparkSession, sf_dir: str, stage_dir: str | None = None) -> Tables:
    """Tables for the report modules from the driver test tables.

    stage_dir: write the derived tool events once as parquet there; tool calls and tool
    results are both column selections of it (one pass over `events` instead of two)."""
    msgs = vm_messages(spark, sf_dir)
    tools = vt_tools(spark, sf_dir)
    if stage_dir:
        tools.write.mode("overwrite").parquet(f"{stage_dir}/tool_events")
        tools = spark.read.schema(tools.schema).parquet(f"{stage_dir}/tool_events")
    per_conv = msgs.groupBy("conversation_uuid").agg(
        F.count(F.lit(1)).cast("int").alias("message_count"),
        F.min("created_at").alias("created_at"),
    )
    convs = (
        vconv(spark, sf_dir).join(per_conv, "conversation_uuid", "left")
        .select("conversation_uuid", "name", "created_at",
                F.coalesce("message_count", F.lit(0)).alias("message_count"))
    )
    tool_calls = tools.select("conversation_uuid", "message_uuid", "name", "input",
                              "start_timestamp", "duration_s")
    tool_results = tools.select("conversation_uuid", "message_uuid", "name", "is_error",
                                F.array("error_text").alias("texts"))
    return Tables(
        conversations=convs,
        messages=msgs,
        tool_calls=tool_calls,
        tool_results=tool_results,
        citations=vc_citations(spark, sf_dir),
        projects=vd_projects(spark, sf_dir),
        docs=vd_docs(spark, sf_dir),
        attachments=va_attachments(spark, sf_dir),
        blocks=vb_blocks(msgs, tools),
    )
