"""DuckDB twins of the nested round trip (`plans/roundtrip.py`): every table flat, without nesting."""

from __future__ import annotations

from parley.oracle.queries import ORACLE
from parley.oracle.views import ctes, wrap

# messages of both kinds, with the position that nesting gives them
FLAT = """
rt_said AS (SELECT message_uuid, concat(conversation_uuid, '/', CAST(position // 64 AS VARCHAR)) AS conversation_uuid, parent_message_uuid, sender,
  CAST(position AS BIGINT) AS place, created_s * 1000000 AS created_us, (created_s + edit_s) * 1000000 AS updated_us, text, thinking,
  attachment_count, file_count FROM vm),
rt_event AS (SELECT event_id, concat('e', CAST(event_id AS VARCHAR)) AS message_uuid, concat('e', CAST(event_id // 8 AS VARCHAR)) AS conversation_uuid,
  epoch_us(ts) AS created_us, event_type, event_type = 'error' AS is_error, value, CAST(props->>'$.k' AS INTEGER) AS k FROM events),
rt_all AS (SELECT message_uuid, conversation_uuid, parent_message_uuid, sender, place, created_us, updated_us, text, thinking, attachment_count, file_count, false AS called FROM rt_said
  UNION ALL SELECT message_uuid, conversation_uuid, NULL, 'assistant', event_id, created_us, created_us, NULL, '', 0, 0, true FROM rt_event),
rt AS (SELECT *, CAST(row_number() OVER (PARTITION BY conversation_uuid ORDER BY place) - 1 AS INTEGER) AS position,
  CASE WHEN called OR thinking <> '' THEN 2 ELSE 1 END AS blocks FROM rt_all),
rt_blocks AS (
  SELECT message_uuid, conversation_uuid, 0 AS position, 'thinking' AS type, CAST(length(thinking) AS BIGINT) AS text_length FROM rt WHERE NOT called AND thinking <> ''
  UNION ALL SELECT message_uuid, conversation_uuid, blocks - 1, 'text', CAST(coalesce(length(text), 0) AS BIGINT) FROM rt WHERE NOT called
  UNION ALL SELECT message_uuid, conversation_uuid, 0, 'tool_use', NULL FROM rt WHERE called
  UNION ALL SELECT message_uuid, conversation_uuid, 1, 'tool_result', NULL FROM rt WHERE called),
rt_docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc_uuid, concat('p', CAST(doc_id // 4 AS VARCHAR)) AS project_uuid, concat(lang, '.txt') AS filename,
  coalesce(text, '') AS content FROM documents),
rt_projects AS (SELECT DISTINCT doc_id // 4 AS p FROM documents),
rt_users AS (SELECT CAST(c_custkey AS VARCHAR) AS uuid, c_name FROM customer),
rt_attached AS (SELECT message_uuid, CAST(i - 1 AS INTEGER) AS position, i, coalesce(text, '') AS text
  FROM rt_said, range(1, 4) t(i) WHERE i <= attachment_count),
rt_files AS (SELECT message_uuid, CAST(i - 1 AS INTEGER) AS position, i FROM rt_said, range(1, 4) t(i) WHERE i <= file_count)
"""

COUNTS = " UNION ALL ".join(f"SELECT '{name}' AS \"table\", count(*) AS \"rows\" FROM {source}" for name, source in (
    ("users", "rt_users"), ("projects", "rt_projects"), ("docs", "rt_docs"), ("conversations", "(SELECT DISTINCT conversation_uuid FROM rt)"),
    ("messages", "rt"), ("blocks", "rt_blocks"), ("tool_calls", "rt_event"), ("tool_results", "rt_event"), ("attachments", "rt_attached"),
    ("files", "rt_files")))

BODIES = {
    "e01_users": "SELECT uuid, c_name AS full_name, lower(c_name || '@x.org') AS email_address FROM rt_users",
    "e02_projects": """SELECT concat('p', CAST(p AS VARCHAR)) AS project_uuid, p % 2 = 0 AS is_private,
       CASE WHEN p % 3 > 0 THEN CAST(p AS VARCHAR) END AS creator_uuid FROM rt_projects""",
    "e03_docs": "SELECT doc_uuid, project_uuid, filename, md5(content) AS content_md5, CAST(length(content) AS BIGINT) AS content_length FROM rt_docs",
    "e04_conversations": """SELECT conversation_uuid, 'chat "' || conversation_uuid || '"' AS name, substr(conversation_uuid, 1, 1) AS account_uuid,
       CAST(min(created_us) AS BIGINT) AS created_us, CAST(count(*) AS INTEGER) AS message_count FROM rt GROUP BY conversation_uuid""",
    "e05_messages": """SELECT message_uuid, conversation_uuid, parent_message_uuid, sender, position, CAST(created_us AS BIGINT) AS created_us,
       CAST(updated_us AS BIGINT) AS updated_us, CAST(coalesce(length(text), 0) AS BIGINT) AS text_length, CAST(blocks AS INTEGER) AS content_block_count,
       CAST(attachment_count AS INTEGER) AS attachment_count, CAST(file_count AS INTEGER) AS file_count, md5(coalesce(text, '')) AS text_md5,
       CAST(coalesce(length(text), 0) AS BIGINT) AS chars_text, CAST(coalesce(length(thinking), 0) AS BIGINT) AS chars_thinking FROM rt""",
    "e06_blocks": """SELECT concat(message_uuid, '#', CAST(position AS VARCHAR)) AS block_id, message_uuid, conversation_uuid,
       CAST(position AS INTEGER) AS position, type, text_length FROM rt_blocks""",
    "e07_tool_calls": """SELECT concat(message_uuid, '#0') AS block_id, message_uuid, message_uuid AS tool_use_id, event_type AS name, k, created_us AS start_us,
       round(round(value * 1e6) / 1e6, 6) AS duration_s FROM rt_event""",
    "e08_tool_results": """SELECT concat(message_uuid, '#1') AS block_id, message_uuid, message_uuid AS tool_use_id, event_type AS name, is_error,
       'said "' || event_type || '" } ]' AS said FROM rt_event""",
    "e09_attachments": """SELECT message_uuid, position, concat('file ', CAST(i AS VARCHAR)) AS file_name, CAST(length(text) * i AS BIGINT) AS file_size,
       CASE WHEN i = 1 THEN 'txt' END AS file_type, CAST(length(substr(text, 1, CAST(i * 10 AS INTEGER))) AS BIGINT) AS content_length FROM rt_attached""",
    "e10_files": "SELECT message_uuid, position, concat(message_uuid, '-', CAST(i AS VARCHAR)) AS file_uuid, 'a } file' AS file_name FROM rt_files",
    "e11_counts": COUNTS,
    "e12_key_violations": """SELECT 'users' AS "table", uuid AS key, CAST(2 AS BIGINT) AS n, 'duplicate key' AS problem FROM rt_users WHERE uuid LIKE '%7'
       UNION ALL SELECT 'docs', '<null>', n, 'missing key' FROM (SELECT count(*) AS n FROM rt_docs WHERE doc_uuid LIKE '%3') WHERE n > 0""",
    "e13_consistency": "SELECT count(*) AS tool_use_blocks, count(*) AS tool_calls, true AS consistent FROM rt_event",
}


def oracle_sql() -> dict[str, str]:
    out = {k: f"WITH {ctes()},{FLAT}{body}" for k, body in BODIES.items()}
    return out | {"w01_csv": wrap(ORACLE["m04_monthly"]), "w02_json": wrap(ORACLE["m08_totals"])}
