"""E1-E13, W1, W2, W5 on the driver tables: a nested export is built from them, written, and read back.

`nested` is the inverse of the flattening in `sources.export`: ordered blocks, attachments and files
go into messages, messages into conversations, docs into projects. Groups are bounded by
construction (64 turns, 8 events, 4 documents), so no JSON value grows with a hot conversation
or source. The rules are those of FIXTURES.md, section "Nested round trip"; the DuckDB twins in
`oracle/roundtrip.py` compute every table flat, without any nesting.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import sinks
from parley.config import Config
from parley.plans import prepare
from parley.plans.base import REGISTRY, _session_key, context_for_testdata, materialize_tables
from parley.sources import export, testdata
from parley.sources.load_metrics import LoadMetrics
from parley.sources.tables import Tables

TURNS, EVENTS, DOCS = 64, 8, 4  # most members of a conversation of turns, one of events, a project
# records of a compressed part file, which is one task's to read: tens of MB of JSON
RECORDS = {"conversations": 4096, "projects": 4096, "users": 1 << 18}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _ordered(position: Column, value: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(position.alias("at"), value.alias("v")))), lambda x: x["v"])


def _numbered(n: Column, each: Callable[[Column], Column]) -> Column:
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), each))


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message of the conversations table, nested content included."""
    m = testdata.vm_messages(spark, sf_dir)
    group = F.floor(F.col("position") / TURNS).cast("long")
    text = F.coalesce("text", F.lit(""))
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("thinking"))
    thought = F.struct(F.lit("thinking").alias("type"), F.lit(None).cast("string").alias("text"), F.col("thinking").alias("thinking"))
    message = F.struct(
        F.col("message_uuid").alias("uuid"), "parent_message_uuid", "sender", F.date_format("created_at", ISO).alias("created_at"),
        F.date_format("updated_at", ISO).alias("updated_at"), F.col("text").alias("text"),
        F.when(F.col("thinking") != "", F.array(thought, said)).otherwise(F.array(said)).alias("content"),
        _numbered(F.col("attachment_count"), lambda i: F.struct(
            F.concat(F.lit("file "), i.cast("string")).alias("file_name"), (F.length(text) * i).cast("long").alias("file_size"),
            F.when(i == 1, F.lit("txt")).alias("file_type"), F.substring(text, F.lit(1), i * 10).alias("extracted_content"))).alias("attachments"),
        _numbered(F.col("file_count"), lambda i: F.struct(F.concat(F.col("message_uuid"), F.lit("-"), i.cast("string")).alias("file_uuid"),
                                                          F.lit("a } file").alias("file_name"))).alias("files"))
    return m.select(F.concat("conversation_uuid", F.lit("/"), group.cast("string")).alias("uuid"), "position", "created_at", message.alias("m"))


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a message with a tool call and its result, as the columns that `_call_json` writes out."""
    e = testdata._read(spark, sf_dir, "events")
    start = F.col("ts").cast("timestamp")
    stop = F.timestamp_micros(F.unix_micros(start) + F.round(F.col("value") * 1e6).cast("long"))
    call = F.struct(F.col("event_type").alias("name"), F.from_json("props", "k INT").alias("input"), start.alias("start"), stop.alias("stop"))
    return e.select(F.concat(F.lit("e"), F.floor(F.col("event_id") / EVENTS).cast("string")).alias("uuid"),
                    F.col("event_id").alias("position"), start.alias("created_at"), call.alias("call"))


def _call_json(event_id: Column, call: Column) -> Column:
    uid = F.concat(F.lit("e"), event_id.cast("string"))
    name, start = call["name"], F.date_format(call["start"], ISO)
    use = F.to_json(F.struct(F.lit("tool_use").alias("type"), uid.alias("id"), name.alias("name"), call["input"].alias("input"),
                             start.alias("start_timestamp"), F.date_format(call["stop"], ISO).alias("stop_timestamp")))
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), uid.alias("tool_use_id"), name.alias("name"),
                                (name == "error").alias("is_error"),
                                F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit('said "'), name, F.lit('" } ]')).alias("text"))).alias("content")))
    head = F.to_json(F.struct(uid.alias("uuid"), F.lit("assistant").alias("sender"), start.alias("created_at"), start.alias("updated_at")))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"content":['), use, F.lit(","), result, F.lit("]}"))


def nested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON lines of conversations, projects and users. Calls are grouped as narrow columns and become JSON in their group."""
    said = _spoken(spark, sf_dir).withColumn("m", F.to_json("m")).withColumn("position", F.col("position").cast("long"))
    messages = said.unionByName(_called(spark, sf_dir), allowMissingColumns=True)
    of = messages.groupBy("uuid").agg(F.collect_list(F.struct("position", "m", "call")).alias("of"), F.min("created_at").alias("created_at"))
    each = F.transform("of", lambda x: F.struct(x["position"].alias("at"), F.coalesce(x["m"], _call_json(x["position"], x["call"])).alias("v")))
    head = F.to_json(F.struct("uuid", F.concat(F.lit('chat "'), F.col("uuid"), F.lit('"')).alias("name"),
                              F.date_format("created_at", ISO).alias("created_at"), F.struct(F.substring("uuid", 1, 1).alias("uuid")).alias("account")))
    conversations = of.select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"chat_messages":['),
                                       F.array_join(F.transform(F.sort_array(each), lambda x: x["v"]), ","), F.lit("]}")).alias("value"))
    d = testdata._read(spark, sf_dir, "documents")
    doc = F.struct(F.col("doc_id").cast("string").alias("uuid"), F.concat("lang", F.lit(".txt")).alias("filename"), F.col("text").alias("content"))
    projects = (d.groupBy(F.floor(F.col("doc_id") / DOCS).alias("p")).agg(_ordered(F.col("doc_id"), doc).alias("docs"))
                .select(F.to_json(F.struct(F.concat(F.lit("p"), F.col("p").cast("string")).alias("uuid"), (F.col("p") % 2 == 0).alias("is_private"),
                                           F.when(F.col("p") % 3 > 0, F.struct(F.col("p").cast("string").alias("uuid"))).alias("creator"), "docs")).alias("value")))
    c = testdata._read(spark, sf_dir, "customer")
    users = c.select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("uuid"), F.col("c_name").alias("full_name"),
                                        F.lower(F.concat("c_name", F.lit("@x.org"))).alias("email_address"))).alias("value"))
    return conversations, projects, users


_EXPORTS: dict[tuple, tuple[Tables, LoadMetrics]] = {}
_LOCK = threading.Lock()


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return loaded(spark, sf_dir)[0]


def loaded(spark: SparkSession, sf_dir: str) -> tuple[Tables, LoadMetrics]:
    """The export of `sf_dir`, written and read back into tables once per application, with the load's figures."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    with _LOCK:
        key = (_session_key(spark), sf_dir)
        if key not in _EXPORTS:
            root = prepare.scratch_dir(spark, "nested")
            for name, df in zip(("conversations", "projects", "users"), nested(spark, sf_dir)):
                df.write.option("maxRecordsPerFile", RECORDS[name]).text(f"{root}/{name}", compression="gzip")
            metrics = LoadMetrics()
            read = export.load_dir(spark, root, stage_dir=prepare.scratch_dir(spark, "nested-staged"))
            _EXPORTS[key] = materialize_tables(spark, read, metrics=metrics), metrics
        return _EXPORTS[key]


def _of(table: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(tables(spark, sf_dir), table).selectExpr(*columns)


def _repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12 on tables with planted faults: users ending in 7 twice, docs ending in 3 without id."""
    t = tables(spark, sf_dir)
    users = t.users.unionByName(t.users.where(F.col("uuid").endswith("7")))
    docs = t.docs.withColumn("doc_uuid", F.when(~F.col("doc_uuid").endswith("3"), F.col("doc_uuid")))
    return export.key_violations(Tables(t.conversations, t.messages, users=users, docs=docs)).select("table", "key", "n", "problem")


def _reread(kind: str, key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = sinks.sanitize_nonfinite(REGISTRY[key][1](context_for_testdata(spark, sf_dir, Config())))
        path = prepare.scratch_dir(spark, f"sink-{kind}")
        (sinks.write_csv if kind == "csv" else sinks.write_json)(frame, path)
        reader = spark.read.schema(frame.schema)
        return reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "e01_users": _of("users", "uuid", "full_name", "email_address"),
    "e02_projects": _of("projects", "project_uuid", "is_private", "creator_uuid"),
    "e03_docs": _of("docs", "doc_uuid", "project_uuid", "filename", "md5(content) AS content_md5", "content_length"),
    "e04_conversations": _of("conversations", "conversation_uuid", "name", "account_uuid", "unix_micros(created_at) AS created_us", "message_count"),
    "e05_messages": _of("messages", "message_uuid", "conversation_uuid", "parent_message_uuid", "sender", "position",
                        "unix_micros(created_at) AS created_us", "unix_micros(updated_at) AS updated_us", "text_length",
                        "content_block_count", "attachment_count", "file_count", "md5(text) AS text_md5", "chars_text", "chars_thinking"),
    "e06_blocks": _of("blocks", "block_id", "message_uuid", "conversation_uuid", "position", "type", "text_length"),
    "e07_tool_calls": _of("tool_calls", "block_id", "message_uuid", "tool_use_id", "name", "cast(get_json_object(input, '$.k') AS int) AS k",
                          "unix_micros(start_timestamp) AS start_us", "round(duration_s, 6) AS duration_s"),
    "e08_tool_results": _of("tool_results", "block_id", "message_uuid", "tool_use_id", "name", "is_error", "array_join(texts, '\\n') AS said"),
    "e09_attachments": _of("attachments", "message_uuid", "position", "file_name", "file_size", "file_type", "content_length"),
    "e10_files": _of("files", "message_uuid", "position", "file_uuid", "file_name"),
    "e11_counts": lambda spark, sf_dir: loaded(spark, sf_dir)[1].counts(spark),
    "e12_key_violations": _repeated_keys,
    "e13_consistency": lambda spark, sf_dir: loaded(spark, sf_dir)[1].consistency(spark),
    "w01_csv": _reread("csv", "m04_monthly"),
    "w02_json": _reread("json", "m08_totals"),
}
