"""Chat export (conversations / projects / users JSON) -> normalised DataFrames.

Per-message work stays row-local: the `content` array of a message is parsed once
(`transform` + `from_json`) and reduced with higher-order functions (ordered text concat,
char sums), so building `messages` needs no explode-and-regroup shuffle. Block-level tables
(blocks, tool calls / results, citations) are narrow explodes of the same rows.

A `.json` file that is a top-level array, the export's own form, is read in byte ranges (`json_array`), down
to single messages, so neither a large file nor a large conversation is one task's work. JSON Lines
(`.jsonl` or a folder of part files, a conversation per line) are split by Spark at line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources import json_array
from parley.sources import schema as SC
from parley.sources.tables import Tables

EXPORT_FILES = ("conversations.json", "projects.json", "users.json")


def find_export(spark: SparkSession, root: str) -> dict[str, str]:
    """Locate the three export inputs at any depth below `root` (a folder with all three first, then the shallowest) and
    raise when one is missing. Each input may be `<name>.json`, `<name>.jsonl`, or a folder
    `<name>/` of part files (large exports: many splittable JSON Lines files read in
    parallel). Listing runs through Spark's file index; only one path per input returns."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select(F.col("path")))
    cand = None
    for name in EXPORT_FILES:
        stem = name.rsplit(".", 1)[0]
        as_file = F.regexp_extract("path", rf"^(.*/{stem}\.jsonl?)$", 1)
        as_dir = F.regexp_extract("path", rf"^(.*/{stem})/[^/]+$", 1)
        one = files.select(F.lit(name).alias("name"), F.when(as_file != "", as_file).when(as_dir != "", as_dir).alias("p"))
        cand = one if cand is None else cand.unionByName(one)
    cand = cand.where("p IS NOT NULL").distinct().withColumn("folder", F.regexp_extract("p", "^(.*)/[^/]+$", 1))
    # one folder that holds all three comes before any file elsewhere, then the fewest path parts
    whole = cand.groupBy("folder").agg((F.count_distinct("name") == len(EXPORT_FILES)).alias("whole"))
    best = (cand.join(whole, "folder").groupBy("name")
            .agg(F.min(F.struct(~F.col("whole"), F.size(F.split("p", "/")), F.col("p").alias("p"))).alias("best")))
    found = {r["name"]: r["best"]["p"] for r in best.collect()}  # one row an input
    for name in EXPORT_FILES:
        if name not in found:
            raise FileNotFoundError(f"missing in export: {name}")
    return found


def _read(spark: SparkSession, path: str, schema, multiline: bool | None) -> DataFrame:
    """A `.json` file is one JSON value (usually an array); `.jsonl` files and folders of part
    files hold a record per line. A record that is no JSON of this shape fails the read."""
    if multiline is None:
        if path.endswith(".json") and json_array.is_array(spark, path):
            text = json_array.records(spark, path, _scratch(spark, "array"))
            return text.select(_parsed("text", schema).alias("r")).select("r.*")
        multiline = path.endswith(".json")
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(path)


def _parsed(text: str, schema) -> Column:
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def _scratch(spark: SparkSession, name: str) -> str:
    from parley.plans.prepare import scratch_dir
    from parley.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return scratch_dir(spark, name)


def _ts(s: Column) -> Column:
    return F.try_to_timestamp(s)


def users(raw: DataFrame) -> DataFrame:
    """E1."""
    return raw.select("uuid", "full_name", "email_address", "verified_phone_number")


def projects(raw: DataFrame) -> DataFrame:
    """Creator flattened NULL-safe."""
    return raw.select(
        F.col("uuid").alias("project_uuid"), "name", "description", "prompt_template", "is_private",
        "is_starter_project", "created_at", "updated_at",
        F.col("creator.uuid").alias("creator_uuid"), F.col("creator.full_name").alias("creator_full_name"))


def docs(raw: DataFrame) -> DataFrame:
    """One row per doc; NULL docs array -> no rows, NULL content -> ''."""
    d = raw.select(F.col("uuid").alias("project_uuid"), F.explode("docs").alias("d"))
    content = F.coalesce(F.col("d.content"), F.lit(""))
    return d.select(F.col("d.uuid").alias("doc_uuid"), "project_uuid", F.col("d.filename").alias("filename"),
                    content.alias("content"), F.length(content).cast("long").alias("content_length"),
                    F.col("d.created_at").alias("created_at"))


def conversations(raw: DataFrame, count: Column | None = None) -> DataFrame:
    """message_count = array length (NULL -> 0), or `count` where the messages were framed apart."""
    count = F.size(F.coalesce("chat_messages", F.array())) if count is None else count
    return raw.select(
        F.col("uuid").alias("conversation_uuid"), "name", "summary", F.col("account.uuid").alias("account_uuid"),
        "created_at", "updated_at", count.cast("int").alias("message_count"))


def message_rows(raw: DataFrame) -> DataFrame:
    """One row per message with its blocks parsed once (`b`) next to their raw JSON text (E6 keeps it).

    Of the message's own text and of attached texts only the lengths are kept."""
    return _message_rows(raw.select(F.col("uuid").alias("conversation_uuid"),
                                    F.posexplode(F.coalesce("chat_messages", F.array())).alias("position", "m")))


def _message_rows(m: DataFrame) -> DataFrame:
    content = F.coalesce(F.col("m.content"), F.array())
    attached = F.transform("m.attachments", lambda a: F.struct(
        a["file_name"].alias("file_name"), a["file_size"].alias("file_size"), a["file_type"].alias("file_type"),
        F.length(F.coalesce(a["extracted_content"], F.lit(""))).cast("long").alias("content_length")))
    kept = F.struct(*[F.col(f"m.{c}").alias(c) for c in ("uuid", "parent_message_uuid", "sender", "created_at", "updated_at")],
                    F.length(F.coalesce(F.col("m.text"), F.lit(""))).cast("long").alias("text_length"),
                    attached.alias("attachments"), F.col("m.files").alias("files"))
    return m.select("conversation_uuid", "position", kept.alias("m"),
                    F.transform(content, lambda b: F.from_json(b, SC.BLOCK_DDL)).alias("b"), content.alias("raw_blocks"))


def framed_conversations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """E4 and `message_rows` of a top-level array, conversations and messages framed in parallel."""
    whole, messages_ = json_array.nested_records(spark, path, "chat_messages", _scratch(spark, "array"))
    whole = whole.select("file", "record", "elements", _parsed("text", SC.CONVERSATION).alias("c"))
    rows = (messages_.join(whole.select("file", "record", F.col("c.uuid").alias("conversation_uuid")), ["file", "record"])
            .select("conversation_uuid", "position", _parsed("text", SC.MESSAGE).alias("m")))
    return conversations(whole.select("c.*", "elements"), F.col("elements")), _message_rows(rows)


def _join_texts(blocks: Column, types: list[str], field: str) -> Column:
    """Texts of the given block types in block order joined by newline; NULLs skipped."""
    picked = F.transform(blocks, lambda x: F.when(x["type"].isin(*types), x[field]))
    return F.array_join(picked, "\n")


def _sum_len(blocks: Column, types: list[str], field: str) -> Column:
    lens = F.transform(blocks, lambda x: F.when(x["type"].isin(*types), F.coalesce(F.length(x[field]), F.lit(0)))
                       .otherwise(F.lit(0)))
    return F.aggregate(lens, F.lit(0).cast("long"), lambda acc, v: acc + v)


def messages(r: DataFrame) -> DataFrame:
    """E5 + S1/S2 from `message_rows`: ordered text / thinking and char sums per message."""
    b = F.col("b")
    thinking_text = F.transform(b, lambda x: F.when(x["type"] == "thinking", x["thinking"]))
    return r.select(
        F.col("m.uuid").alias("message_uuid"), "conversation_uuid",
        F.col("m.parent_message_uuid").alias("parent_message_uuid"), F.col("m.sender").alias("sender"),
        F.col("position").cast("int").alias("position"),
        F.col("m.created_at").alias("created_at"), F.col("m.updated_at").alias("updated_at"),
        F.col("m.text_length").alias("text_length"),
        F.size(b).cast("int").alias("content_block_count"),
        F.size(F.coalesce(F.col("m.attachments"), F.array())).cast("int").alias("attachment_count"),
        F.size(F.coalesce(F.col("m.files"), F.array())).cast("int").alias("file_count"),
        _join_texts(b, ["text", "voice_note"], "text").alias("text"),
        F.array_join(thinking_text, "\n").alias("thinking"),
        _sum_len(b, ["text", "voice_note"], "text").alias("chars_text"),
        _sum_len(b, ["thinking"], "thinking").alias("chars_thinking"),
    )


def blocks(rows: DataFrame) -> DataFrame:
    """E6 from `message_rows`: one row per content block; text_length only for text /
    thinking / voice_note."""
    r = rows.select("conversation_uuid", F.col("m.uuid").alias("message_uuid"),
                                  F.posexplode(F.arrays_zip("b", "raw_blocks")).alias("position", "z"))
    x = F.col("z.b")
    tl = (F.when(x["type"].isin("text", "voice_note"), F.coalesce(F.length(x["text"]), F.lit(0)))
          .when(x["type"] == "thinking", F.coalesce(F.length(x["thinking"]), F.lit(0))))
    return r.select(
        F.concat("message_uuid", F.lit("#"), F.col("position").cast("string")).alias("block_id"),
        "message_uuid", "conversation_uuid", F.col("position").cast("int").alias("position"),
        x["type"].alias("type"), _ts(x["start_timestamp"]).alias("start_timestamp"),
        _ts(x["stop_timestamp"]).alias("stop_timestamp"), tl.cast("long").alias("text_length"),
        F.col("z.raw_blocks").alias("raw"), x.alias("b"))


def tool_calls(bl: DataFrame) -> DataFrame:
    """tool_use blocks widened; duration from start / stop when both are present."""
    t = bl.where(F.col("type") == "tool_use")
    return t.select(
        "block_id", "message_uuid", "conversation_uuid", F.col("b.id").alias("tool_use_id"),
        F.col("b.name").alias("name"), F.col("b.integration_name").alias("integration_name"),
        F.col("b.is_mcp_app").alias("is_mcp_app"), F.col("b.mcp_server_url").alias("mcp_server_url"),
        F.col("b.input").alias("input"), "start_timestamp", "stop_timestamp",
        ((F.unix_micros("stop_timestamp") - F.unix_micros("start_timestamp")) / F.lit(1e6)).alias("duration_s"))


def tool_results(bl: DataFrame) -> DataFrame:
    """tool_result blocks widened; `texts` = text of each content element (m12.4)."""
    t = bl.where(F.col("type") == "tool_result")
    items = F.from_json(F.col("b.content"), SC.RESULT_CONTENT_DDL)
    return t.select(
        "block_id", "message_uuid", "conversation_uuid", F.col("b.tool_use_id").alias("tool_use_id"),
        F.col("b.name").alias("name"), F.col("b.is_error").alias("is_error"),
        F.col("b.content").alias("content"), F.col("b.structured_content").alias("structured_content"),
        "start_timestamp", "stop_timestamp",
        F.coalesce(F.transform(items, lambda e: e["text"]), F.array().cast("array<string>")).alias("texts"))


def citations(bl: DataFrame) -> DataFrame:
    """m11.1: citations of text blocks -> type, url, host."""
    t = bl.where(F.col("type") == "text").select(
        "conversation_uuid", "message_uuid", F.col("start_timestamp").alias("cited_at"),
        F.explode(F.from_json(F.col("b.citations"), SC.CITATIONS_DDL)).alias("c"))
    url = F.col("c.details.url")
    return t.select("conversation_uuid", "message_uuid", F.col("c.details.type").alias("cite_type"),
                    url.alias("url"), F.regexp_extract(url, r"https?://([^/]+)", 1).alias("domain"), "cited_at")


def attachments(rows: DataFrame) -> DataFrame:
    """E9 from `message_rows`: extracted text dropped, only its length kept."""
    a = rows.select(F.col("m.uuid").alias("message_uuid"),
                                  F.posexplode(F.col("m.attachments")).alias("position", "a"))
    return a.select("message_uuid", F.col("position").cast("int").alias("position"),
                    F.col("a.file_name").alias("file_name"), F.col("a.file_size").alias("file_size"),
                    F.col("a.file_type").alias("file_type"), F.col("a.content_length").alias("content_length"))


def files(rows: DataFrame) -> DataFrame:
    """E10 from `message_rows`."""
    f = rows.select(F.col("m.uuid").alias("message_uuid"),
                                  F.posexplode(F.col("m.files")).alias("position", "f"))
    return f.select("message_uuid", F.col("position").cast("int").alias("position"),
                    F.col("f.file_uuid").alias("file_uuid"), F.col("f.file_name").alias("file_name"))


def load(spark: SparkSession, conversations_path: str, projects_path: str | None = None,
         users_path: str | None = None, multiline: bool | None = None, stage_dir: str | None = None) -> Tables:
    """Normalised tables of one export (lazy DataFrames).

    stage_dir: parse the conversations file once into parquet there (conversation rows and
    message rows with parsed blocks) and derive every table from it; without it each table
    re-reads the JSON. Use a folder on shared storage (e.g. under spark.checkpoint.dir)."""
    if multiline is None and conversations_path.endswith(".json") and json_array.is_array(spark, conversations_path):
        convs, rows = framed_conversations(spark, conversations_path)
    else:
        craw = _read(spark, conversations_path, SC.CONVERSATION, multiline)
        convs, rows = conversations(craw), message_rows(craw)
    if stage_dir:
        convs.write.mode("overwrite").parquet(f"{stage_dir}/conversations", compression="zstd")
        rows.write.mode("overwrite").parquet(f"{stage_dir}/message_rows", compression="zstd")
        convs = spark.read.schema(convs.schema).parquet(f"{stage_dir}/conversations")
        rows = spark.read.schema(rows.schema).parquet(f"{stage_dir}/message_rows")
    bl = blocks(rows)
    praw = _read(spark, projects_path, SC.PROJECT, multiline) if projects_path else None
    uraw = _read(spark, users_path, SC.USER, multiline) if users_path else None
    return Tables(
        conversations=convs,
        messages=messages(rows),
        tool_calls=tool_calls(bl),
        tool_results=tool_results(bl),
        citations=citations(bl),
        projects=projects(praw) if praw is not None else None,
        docs=docs(praw) if praw is not None else None,
        attachments=attachments(rows),
        files=files(rows),
        blocks=bl.drop("b"),
        users=users(uraw) if uraw is not None else None,
    )


def load_dir(spark: SparkSession, root: str, multiline: bool | None = None, stage_dir: str | None = None) -> Tables:
    p = find_export(spark, root)
    return load(spark, p["conversations.json"], p["projects.json"], p["users.json"], multiline, stage_dir)


# ---------------------------------------------------------------- validation

PRIMARY_KEYS = {
    "users": ["uuid"],
    "projects": ["project_uuid"],
    "docs": ["doc_uuid"],
    "conversations": ["conversation_uuid"],
    "messages": ["message_uuid"],
    "blocks": ["block_id"],
    "tool_calls": ["block_id"],
    "tool_results": ["block_id"],
    "attachments": ["message_uuid", "position"],
    "files": ["message_uuid", "position"],
}


def load_counts(t: Tables) -> DataFrame:
    """Rows per table, one aggregation per table unioned into one frame."""
    out = None
    for name in PRIMARY_KEYS:
        df = getattr(t, name, None)
        if df is None:
            continue
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def key_violations(t: Tables) -> DataFrame:
    """Duplicate or missing primary keys (empty frame = valid).

    One keyed aggregation over the keys of all tables together, so one exchange whatever the number of
    tables; partial aggregation makes a hot key one row per map task, never a whole group in one task."""
    out = None
    for name, keys in PRIMARY_KEYS.items():
        df = getattr(t, name, None)
        if df is None:
            continue
        k = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in keys])
        one = df.select(F.lit(name).alias("table"), k.alias("key"), _missing_key(keys).cast("int").alias("null_key"))
        out = one if out is None else out.unionByName(one)
    g = out.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"), F.max("null_key").alias("null_key"))
    return g.where((F.col("n") > 1) | (F.col("null_key") == 1)).select(
        "table", "key", "n", F.when(F.col("null_key") == 1, F.lit("missing key")).otherwise(F.lit("duplicate key")).alias("problem"))


def _missing_key(keys: list[str]) -> Column:
    missing = F.lit(False)
    for c in keys:
        missing = missing | F.col(c).isNull()
    return missing


def validate(t: Tables) -> None:
    """Raise when any primary key is duplicated or missing (bounded sample in the message)."""
    bad = key_violations(t).limit(20).collect()
    if bad:
        raise ValueError("key violations: " + "; ".join(f"{r.table}:{r.key} ({r.problem}, n={r.n})" for r in bad))


def consistency(t: Tables) -> DataFrame:
    """tool_use block count must equal tool_calls row count."""
    a = t.blocks.agg(F.count_if(F.col("type") == "tool_use").alias("tool_use_blocks"))
    b = t.tool_calls.agg(F.count(F.lit(1)).alias("tool_calls"))
    return a.select("tool_use_blocks", b.scalar().alias("tool_calls"),
                    (F.col("tool_use_blocks") == b.scalar()).alias("consistent"))
