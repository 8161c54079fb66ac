"""Per-message, per-code-block and per-conversation stat tables.

Shuffle plan (what `.explain()` shows):
  * per message uuid   ONE partial aggregation over a union of tool calls, tool results and
                       child rows (a child is keyed by its parent's uuid; root / NULL parents
                       are filtered before the exchange — they would be one giant key), joined
                       to the messages on their unique uuid
  * fork_child flag    the same aggregate looked up by parent_message_uuid on the narrow
                       (uuid, parent) projection; a parent with very many children is a skewed
                       key on that side only -> AQE skew join. The wide rows join once, by uuid
  * per conversation   one groupBy(conversation_uuid) with partial aggregation
The text is scanned once: token estimates, tag and lengths of every fenced block (an array
column, from which the code-block table is exploded) and inline spans are JVM expressions in the
scan stage. Code bodies are neither shuffled nor stored. Nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.config import SENTINEL_ROOT, Config
from parley.functions import text as T
from parley.functions import time as TM
from parley.sources.tables import Tables


@dataclass
class Stats:
    message: DataFrame
    code_block: DataFrame
    conversation: DataFrame


def is_root_parent(col: str = "parent_message_uuid"):
    return F.col(col).isNull() | (F.col(col) == SENTINEL_ROOT)


def child_counts(messages: DataFrame) -> DataFrame:
    """Children per non-root parent."""
    return (
        messages.where(~is_root_parent())
        .groupBy(F.col("parent_message_uuid").alias("puuid"))
        .agg(F.count(F.lit(1)).alias("child_count"))
    )


def stats_message(t: Tables, cfg: Config) -> DataFrame:
    m = t.messages
    base = m.select(
        "message_uuid", "conversation_uuid", "parent_message_uuid", "sender", "position",
        "created_at", "updated_at", "attachment_count", "file_count",
        F.coalesce("chars_text", F.lit(0)).cast("long").alias("chars_text"),
        F.coalesce("chars_thinking", F.lit(0)).cast("long").alias("chars_thinking"),
        TM.local("created_at", cfg.tz).alias("created_local"),
        T.approx_tokens("text").alias("tokens_text"),
        T.approx_tokens("thinking").alias("tokens_thinking"),
        T.fences("text").alias("fences"),
        T.inline_code_count("text").alias("inline_code_count"),
    )
    # S4's length: the bodies and a blank line (2 characters) between neighbours
    chars = (F.aggregate("fences.chars", F.lit(0).cast("long"), lambda a, n: a + n)
             + 2 * F.greatest(F.size("fences") - 1, F.lit(0))).cast("long")
    base = base.select("*", chars.alias("chars_code")).select("*", T.tokens_of("chars_code").alias("tokens_code"))

    # One aggregation keyed by message uuid for everything counted "per message": tool calls,
    # tool results, and children (a child row is keyed by its parent's uuid). Root / NULL
    # parents are dropped before the exchange (they would form one giant key).
    parts = [m.where(~is_root_parent()).select(F.col("parent_message_uuid").alias("message_uuid"),
                                               F.lit(0).alias("c"), F.lit(0).alias("r"), F.lit(1).alias("k"))]
    if t.tool_calls is not None:
        parts.append(t.tool_calls.select("message_uuid", F.lit(1).alias("c"), F.lit(0).alias("r"), F.lit(0).alias("k")))
    if t.tool_results is not None:
        parts.append(t.tool_results.select("message_uuid", F.lit(0).alias("c"), F.lit(1).alias("r"),
                                           F.lit(0).alias("k")))
    per_uuid = parts[0]
    for p in parts[1:]:
        per_uuid = per_uuid.unionByName(p)
    per_uuid = per_uuid.where(F.col("message_uuid").isNotNull()).groupBy("message_uuid").agg(
        F.sum("c").alias("tool_use_count"), F.sum("r").alias("tool_result_count"), F.sum("k").alias("child_count"))
    # parent's children (S10): the same aggregate looked up by the parent key, on the narrow
    # (uuid, parent) projection of rows that have a real parent; both facts meet in one
    # aggregate by uuid, and the wide per-message rows are shuffled once, for one join with it
    parent_cc = per_uuid.where(F.col("child_count") > 0).select(
        F.col("message_uuid").alias("parent_message_uuid"), F.col("child_count").alias("_siblings"))
    counts = ("tool_use_count", "tool_result_count", "child_count")
    siblings = (m.where(~is_root_parent() & F.col("message_uuid").isNotNull())
                .select("message_uuid", "parent_message_uuid").join(parent_cc, "parent_message_uuid")
                .select("message_uuid", "_siblings", *[F.lit(None).cast("long").alias(c) for c in counts]))
    flags = (siblings.unionByName(per_uuid.withColumn("_siblings", F.lit(None).cast("long")))
             .groupBy("message_uuid").agg(*[F.max(c).alias(c) for c in ("_siblings", *counts)]))
    base = base.join(flags, "message_uuid", "left")

    delta = TM.epoch_seconds_between("updated_at", "created_at")
    both = F.col("updated_at").isNotNull() & F.col("created_at").isNotNull()
    fork_child = (~is_root_parent()) & (F.coalesce(F.col("_siblings"), F.lit(0)) > 1)
    return base.select(
        "message_uuid", "conversation_uuid", "parent_message_uuid", "sender", "position",
        "created_at", "created_local",
        "chars_text", "chars_thinking",
        F.coalesce("tool_use_count", F.lit(0)).cast("long").alias("tool_use_count"),
        F.coalesce("tool_result_count", F.lit(0)).cast("long").alias("tool_result_count"),
        F.coalesce("attachment_count", F.lit(0)).cast("long").alias("attachment_count"),
        F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"),
        "tokens_text", "tokens_thinking", "chars_code", "tokens_code", "inline_code_count", "fences",
        F.when(both, delta).alias("edit_delta_seconds"),
        F.coalesce(both & (F.col("chars_text") > 0) & (delta > 60), F.lit(False)).alias("inplace_edit_flag"),
        F.coalesce(F.col("child_count"), F.lit(0)).cast("long").alias("child_count"),
        (F.coalesce(F.col("child_count"), F.lit(0)) > 1).alias("fork_parent_flag"),
        fork_child.alias("fork_child_flag"),
        (fork_child & (F.coalesce(F.col("child_count"), F.lit(0)) > 0)).alias("fork_child_continued"),
        is_root_parent().alias("is_root"),
    )


def stats_code_block(sm: DataFrame) -> DataFrame:
    """One row per fenced block of the message text (thinking excluded), exploded from the
    `fences` column of the message stats (the text is not read again)."""
    b = sm.select("message_uuid", "conversation_uuid", "sender", F.posexplode("fences").alias("position", "f"))
    return b.select(
        "message_uuid", "conversation_uuid", "sender",
        F.col("position").cast("int").alias("position"),
        T.strip_ws(F.col("f.tag")).alias("language"),
        F.col("f.chars").alias("chars"),
        T.tokens_of("f.chars").alias("tokens"),
    )


def stats_conversation(t: Tables, sm: DataFrame, cfg: Config) -> DataFrame:
    """One row per conversation, empty conversations kept with zeros."""
    human = F.col("sender") == "human"
    asst = F.col("sender") == "assistant"

    def s(cond, val=F.lit(1)):
        return F.sum(F.when(cond, val).otherwise(0))

    agg = sm.groupBy("conversation_uuid").agg(
        F.min("created_at").alias("first_msg_at"),
        F.max("created_at").alias("last_msg_at"),
        s(human, F.col("chars_text")).alias("chars_human"),
        s(asst, F.col("chars_text")).alias("chars_assistant"),
        s(human, F.col("tokens_text")).alias("tokens_human"),
        s(asst, F.col("tokens_text")).alias("tokens_assistant"),
        F.sum("chars_thinking").alias("chars_thinking_total"),
        F.sum("tokens_thinking").alias("tokens_thinking_total"),
        F.sum("attachment_count").alias("attachment_total"),
        F.sum("file_count").alias("file_total"),
        F.bool_or(F.col("chars_thinking") > 0).alias("has_thinking"),
        s(human).alias("human_turn_count"),
        s(asst).alias("assistant_turn_count"),
        F.bool_or("fork_parent_flag").alias("has_fork"),
        s(F.col("fork_parent_flag")).alias("fork_count"),
        s(F.col("fork_parent_flag") & asst).alias("human_fork_count"),
        s(F.col("fork_parent_flag") & human).alias("assistant_fork_count"),
        s(F.col("inplace_edit_flag")).alias("inplace_edit_count"),
        s(F.col("is_root")).alias("root_count"),
    )
    c = t.conversations.join(agg, "conversation_uuid", "left")
    if t.tool_calls is not None:
        tools = t.tool_calls.groupBy("conversation_uuid").agg(F.count(F.lit(1)).alias("tool_calls_total"))
        c = c.join(tools, "conversation_uuid", "left")
    else:
        c = c.withColumn("tool_calls_total", F.lit(0))

    def z(name):
        return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)

    return c.select(
        "conversation_uuid", "name", "created_at",
        TM.local("created_at", cfg.tz).alias("created_local"),
        F.col("message_count").cast("long").alias("message_count"),
        "first_msg_at", "last_msg_at",
        F.coalesce(TM.epoch_seconds_between("last_msg_at", "first_msg_at"), F.lit(0.0)).alias("lifetime_seconds"),
        z("chars_human"), z("chars_assistant"), z("tokens_human"), z("tokens_assistant"),
        z("chars_thinking_total"), z("tokens_thinking_total"), z("tool_calls_total"),
        z("attachment_total"), z("file_total"),
        F.coalesce("has_thinking", F.lit(False)).alias("has_thinking"),
        z("human_turn_count"), z("assistant_turn_count"),
        F.coalesce("has_fork", F.lit(False)).alias("has_fork"),
        z("fork_count"), z("human_fork_count"), z("assistant_fork_count"),
        z("inplace_edit_count"), z("root_count"),
    )


def sanity(stats: Stats) -> DataFrame:
    """One row (conversations, messages, avg message_count) from one union scan."""
    conv = stats.conversation.select(F.lit(1).alias("c"), F.col("message_count").alias("mc"), F.lit(0).alias("m"))
    msg = stats.message.select(F.lit(0).alias("c"), F.lit(None).cast("long").alias("mc"), F.lit(1).alias("m"))
    return conv.unionByName(msg).agg(
        F.sum("c").cast("long").alias("conversations"),
        F.sum("m").cast("long").alias("messages"),
        F.round(F.avg("mc"), 6).alias("avg_message_count"),
    )


def assert_sane(stats: Stats) -> dict:
    """Raise when the stat tables are empty; returns the single sanity row."""
    row = sanity(stats).collect()[0].asDict()  # one aggregated row
    if not row["conversations"] or not row["messages"] or row["avg_message_count"] is None:
        raise ValueError(f"stat tables are empty: {row}")
    return row


def build(t: Tables, cfg: Config) -> Stats:
    sm = stats_message(t, cfg)
    return Stats(message=sm, code_block=stats_code_block(sm), conversation=stats_conversation(t, sm, cfg))


def build_materialized(t: Tables, cfg: Config, spark=None, base_dir: str | None = None) -> Stats:
    """Build the stat tables and write each once as parquet under the shared checkpoint
    folder, in dependency order: message stats first; code blocks and conversation stats are
    then computed FROM the written message stats, so the per-message stage (text regex, the
    per-uuid aggregate and its joins) runs exactly once. Lineage is cut (a lost executor
    re-reads files), and readers get column pruning and predicate pushdown. The folder comes
    from spark.checkpoint.dir (set by the cluster; tests set their own when it is unset)."""
    spark = spark or t.messages.sparkSession
    base = base_dir or scratch_dir(spark, "stats")

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")  # known schema: no inference

    sm = write(stats_message(t, cfg), "message")
    return Stats(message=sm, code_block=write(stats_code_block(sm), "code_block"),
                 conversation=write(stats_conversation(t, sm, cfg), "conversation"))


def scratch_dir(spark, what: str) -> str:
    import uuid

    from parley.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/parley/{what}-{uuid.uuid4().hex[:12]}"
