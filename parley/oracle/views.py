"""DuckDB text of the test views (FIXTURES.md) and of the stat tables, as CTEs.

Every oracle query is `WITH <these ctes> <body>`; DuckDB drops unused CTEs.
Views read the driver's pre-registered tables (conversations, events, documents, pages).
"""

from __future__ import annotations

SENTINEL = "00000000-0000-4000-8000-000000000000"
TZ = "Europe/Istanbul"


def _tok(x: str) -> str:
    return f"CAST(CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END AS BIGINT)"


FENCE = "(?s)```([^\\n]*)\\n(.*?)(?:```|\\z)"

VM = r"""
SELECT concat(CAST(conv_id AS VARCHAR),'#',CAST(turn AS VARCHAR)) AS message_uuid,
       CAST(conv_id AS VARCHAR) AS conversation_uuid,
       CASE WHEN turn = 0 THEN '00000000-0000-4000-8000-000000000000'
            WHEN turn = 5 AND conv_id % 12 = 0 THEN CAST(NULL AS VARCHAR)
            WHEN turn >= 3 AND (conv_id + turn) % 5 = 0 THEN concat(CAST(conv_id AS VARCHAR),'#',CAST(turn-3 AS VARCHAR))
            ELSE concat(CAST(conv_id AS VARCHAR),'#',CAST(turn-1 AS VARCHAR)) END AS parent_message_uuid,
       CASE role WHEN 'user' THEN 'human' ELSE role END AS sender,
       CAST(turn AS INT) AS position,
       1704067200 + conv_id*26000 + conv_id % 14 * 2592000 + turn*900 + (conv_id*17 + turn*131) % 880
         + CASE WHEN conv_id % 10 = 0 AND turn >= 4 THEN 90000 ELSE 0 END AS created_s,
       CASE WHEN (conv_id + turn) % 9 = 0 THEN 61 + (conv_id*7919 + turn*104729) % 700000
            ELSE (conv_id + turn) % 5 END AS edit_s,
       CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 = 0
            THEN concat(text, chr(10), repeat(chr(96),3),
                 CASE conv_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'py' WHEN 2 THEN 'JS ' WHEN 3 THEN '' ELSE 'bash x' END,
                 chr(10), substr(text,1,200), chr(10), repeat(chr(96),3), chr(10), 'see ', chr(96), 'x', chr(96))
            ELSE text END AS text,
       CASE WHEN role = 'assistant' AND conv_id % 4 = 0 THEN substr(text, 1, CAST((conv_id*turn) % 400 AS INT)) ELSE '' END AS thinking,
       CASE WHEN role = 'user' AND conv_id % 6 = 0 THEN 1 + conv_id % 3 ELSE 0 END AS attachment_count,
       CASE WHEN role = 'user' AND conv_id % 8 = 0 THEN 1 + conv_id % 2 ELSE 0 END AS file_count
FROM conversations
"""

VCONV = """
SELECT CAST(id AS VARCHAR) AS conversation_uuid, concat('conv ', CAST(id % 37 AS VARCHAR)) AS name
FROM (SELECT conv_id AS id FROM conversations UNION SELECT user_id AS id FROM events) u
"""

VT = """
SELECT event_id, CAST(user_id AS VARCHAR) AS conversation_uuid,
       concat(CAST(user_id AS VARCHAR),'#',CAST(1 + event_id % 8 AS VARCHAR)) AS message_uuid,
       CASE k % 9 WHEN 0 THEN 'web_search' WHEN 1 THEN 'web_fetch' WHEN 2 THEN 'filesystem:write_file' WHEN 3 THEN 'bash_tool'
            WHEN 4 THEN 'view' WHEN 5 THEN 'artifacts' WHEN 6 THEN 'grep' WHEN 7 THEN 'list_directory' ELSE 'custom:x' END AS name,
       event_type = 'error' AS is_error, ts AS start_timestamp, value AS duration_s,
       CASE WHEN k % 9 <> 5 OR event_id % 8 = 0 THEN props WHEN event_id % 8 = 1 THEN 'not json {'
            ELSE concat('{"type":"', ['text/markdown','application/vnd.ant.code','application/vnd.ant.react','image/svg+xml','text/html','x/other',''][event_id % 7 + 1],
                        '","command":"', ['create','update','rewrite',''][event_id % 4 + 1],
                        '","language":"', ['python','javascript','','sql','rust'][event_id % 5 + 1],
                        '","content":"', repeat('x', CAST((event_id * 37) % 9000 AS INT)), '"}') END AS input,
       CASE k % 11 WHEN 0 THEN 'File not found: /tmp/a.txt' WHEN 1 THEN 'HTTP 403 forbidden' WHEN 2 THEN 'Request timed out'
            WHEN 3 THEN '429 Too Many Requests' WHEN 4 THEN 'blocked by robots.txt' WHEN 5 THEN 'client_error: https://a.b/c'
            WHEN 6 THEN 'validation failed' WHEN 7 THEN 'No result received' WHEN 8 THEN 'parse error' WHEN 9 THEN 'unknown error' ELSE 'boom' END AS error_text
FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events) e
"""

VD_DOCS = """
SELECT CAST(doc_id AS VARCHAR) AS doc_uuid, source AS project_uuid, CAST(length(text) AS BIGINT) AS content_length FROM documents
"""

VD_PROJECTS = """
SELECT source AS project_uuid, source AS name,
       CASE WHEN MIN(doc_id) % 3 = 0 THEN '' ELSE concat('about ', source) END AS description,
       CASE WHEN MIN(doc_id) % 4 = 0 THEN NULL ELSE repeat('p', CAST((MIN(doc_id)*311) % 6000 AS INT)) END AS prompt_template,
       MIN(doc_id) % 2 = 0 AS is_private, MIN(doc_id) % 7 = 0 AS is_starter_project,
       make_timestamp((1704067200 + MIN(doc_id)*900000) * 1000000) AS created_at
FROM documents GROUP BY source
"""

VC = r"""
SELECT CAST(page_id % 40 AS VARCHAR) AS conversation_uuid,
       concat(CAST(page_id % 40 AS VARCHAR), '#', CAST(1 + page_id % 4 AS VARCHAR)) AS message_uuid,
       'web_search_citation' AS cite_type, url, regexp_extract(url, 'https?://([^/]+)', 1) AS domain,
       CASE WHEN page_id % 10 <> 0 THEN make_timestamp((1704067200 + page_id * 259200) * 1000000) END AS cited_at FROM pages
"""

VA = """
SELECT concat(CAST(conv_id AS VARCHAR),'#',CAST(turn AS VARCHAR)) AS message_uuid, position,
       CAST(x % [NULL, 1000, 10000, 100000, 1000000, 5000000, 10][x % 7 + 1] AS BIGINT) AS file_size,
       ['txt','application/pdf','','image/png','text/csv','md','json','py','html',NULL][x % 10 + 1] AS file_type
FROM (SELECT *, conv_id * 7919 + turn * 104729 + position * 31 AS x
      FROM (SELECT conv_id, turn, unnest(range(0, conv_id % 3 + 1)) AS position FROM conversations
            WHERE role = 'user' AND conv_id % 6 = 0)) a
"""

VB = """
SELECT message_uuid, 'thinking' AS type FROM msg WHERE chars_thinking > 0
UNION ALL SELECT message_uuid, CASE WHEN sender = 'human' AND CAST(conversation_uuid AS BIGINT) % 11 = 3
                               THEN 'voice_note' ELSE 'text' END FROM msg WHERE chars_text > 0
UNION ALL SELECT message_uuid, unnest(['tool_use', 'tool_result']) FROM vt
"""


# Single-backtick spans without lookbehind (RE2 has none): tokenise the text into backtick runs
# and the gaps between them; encode runs as S (one backtick) / M (several) and gaps as g (no
# newline) / n; a span is a non-overlapping "SgS". Equal to the lookbehind pattern (fuzzed).
INLINE = ("len(regexp_extract_all(array_to_string(list_transform(regexp_extract_all(coalesce({t}, ''), '`+|[^`]+'), "
          "lambda x: CASE WHEN x[1] = chr(96) THEN (CASE WHEN length(x) = 1 THEN 'S' ELSE 'M' END) "
          "ELSE (CASE WHEN contains(x, chr(10)) THEN 'n' ELSE 'g' END) END), ''), 'SgS'))")


def ctes(tz: str = TZ) -> str:
    code = f"array_to_string(regexp_extract_all(coalesce(text, ''), '{FENCE}', 2), chr(10) || chr(10))"
    return f"""
vm AS ({VM}),
msg AS (
  SELECT *, make_timestamp(created_s * 1000000) AS created_at,
         make_timestamp((created_s + edit_s) * 1000000) AS updated_at,
         CAST(length(text) AS BIGINT) AS chars_text, CAST(length(thinking) AS BIGINT) AS chars_thinking
  FROM vm),
vt AS ({VT}),
vconv AS ({VCONV}),
docs AS ({VD_DOCS}),
projects AS ({VD_PROJECTS}),
cites AS ({VC}),
attachments AS ({VA}),
blocks AS ({VB}),
conv AS (
  SELECT v.conversation_uuid, v.name, p.created_at, CAST(coalesce(p.message_count, 0) AS BIGINT) AS message_count
  FROM vconv v LEFT JOIN (SELECT conversation_uuid, count(*) AS message_count, min(created_at) AS created_at
                          FROM msg GROUP BY 1) p USING (conversation_uuid)),
pc AS (
  SELECT parent_message_uuid AS puuid, count(*) AS child_count FROM msg
  WHERE parent_message_uuid IS NOT NULL AND parent_message_uuid <> '{SENTINEL}' GROUP BY 1),
tcm AS (SELECT message_uuid, count(*) AS n FROM vt GROUP BY 1),
sm0 AS (
  SELECT m.*, {code} AS code_text FROM msg m),
sm AS (
  SELECT m.message_uuid, m.conversation_uuid, m.parent_message_uuid, m.sender, m.position, m.created_at,
         (m.created_at AT TIME ZONE 'UTC') AT TIME ZONE '{tz}' AS created_local,
         m.chars_text, m.chars_thinking,
         CAST(coalesce(t.n, 0) AS BIGINT) AS tool_use_count,
         CAST(coalesce(t.n, 0) AS BIGINT) AS tool_result_count,
         CAST(m.attachment_count AS BIGINT) AS attachment_count, CAST(m.file_count AS BIGINT) AS file_count,
         {_tok('m.text')} AS tokens_text, {_tok('m.thinking')} AS tokens_thinking,
         CAST(length(m.code_text) AS BIGINT) AS chars_code, {_tok('m.code_text')} AS tokens_code,
         CAST({INLINE.format(t='m.text')} AS BIGINT) AS inline_code_count,
         CASE WHEN m.updated_at IS NOT NULL AND m.created_at IS NOT NULL
              THEN epoch(m.updated_at) - epoch(m.created_at) END AS edit_delta_seconds,
         coalesce(m.updated_at IS NOT NULL AND m.created_at IS NOT NULL AND m.chars_text > 0
                  AND epoch(m.updated_at) - epoch(m.created_at) > 60, FALSE) AS inplace_edit_flag,
         CAST(coalesce(c.child_count, 0) AS BIGINT) AS child_count,
         coalesce(c.child_count, 0) > 1 AS fork_parent_flag,
         (m.parent_message_uuid IS NOT NULL AND m.parent_message_uuid <> '{SENTINEL}'
          AND coalesce(p.child_count, 0) > 1) AS fork_child_flag,
         (m.parent_message_uuid IS NOT NULL AND m.parent_message_uuid <> '{SENTINEL}'
          AND coalesce(p.child_count, 0) > 1 AND coalesce(c.child_count, 0) > 0) AS fork_child_continued,
         (m.parent_message_uuid IS NULL OR m.parent_message_uuid = '{SENTINEL}') AS is_root
  FROM sm0 m
  LEFT JOIN tcm t ON t.message_uuid = m.message_uuid
  LEFT JOIN pc c ON c.puuid = m.message_uuid
  LEFT JOIN pc p ON p.puuid = m.parent_message_uuid),
cb AS (
  SELECT x.message_uuid, x.conversation_uuid, x.sender, CAST(x.i - 1 AS INTEGER) AS position,
         regexp_replace(x.tags[x.i], '^\\s+|\\s+$', '', 'g') AS language,
         CAST(length(x.bodies[x.i]) AS BIGINT) AS chars, {_tok('x.bodies[x.i]')} AS tokens
  FROM (SELECT m.message_uuid, s.conversation_uuid, s.sender, t.tags, t.bodies,
               unnest(range(1, len(t.bodies) + 1)) AS i
        FROM msg m
        JOIN sm s ON s.message_uuid = m.message_uuid,
        LATERAL (SELECT regexp_extract_all(coalesce(m.text, ''), '{FENCE}', 1) AS tags,
                        regexp_extract_all(coalesce(m.text, ''), '{FENCE}', 2) AS bodies) t) x),
tcc AS (SELECT conversation_uuid, count(*) AS n FROM vt GROUP BY 1),
sc AS (
  SELECT c.conversation_uuid, c.name, c.created_at,
         (c.created_at AT TIME ZONE 'UTC') AT TIME ZONE '{tz}' AS created_local,
         c.message_count,
         a.first_msg_at, a.last_msg_at,
         coalesce(epoch(a.last_msg_at) - epoch(a.first_msg_at), 0.0) AS lifetime_seconds,
         CAST(coalesce(a.chars_human, 0) AS BIGINT) AS chars_human,
         CAST(coalesce(a.chars_assistant, 0) AS BIGINT) AS chars_assistant,
         CAST(coalesce(a.tokens_human, 0) AS BIGINT) AS tokens_human,
         CAST(coalesce(a.tokens_assistant, 0) AS BIGINT) AS tokens_assistant,
         CAST(coalesce(a.chars_thinking_total, 0) AS BIGINT) AS chars_thinking_total,
         CAST(coalesce(a.tokens_thinking_total, 0) AS BIGINT) AS tokens_thinking_total,
         CAST(coalesce(t.n, 0) AS BIGINT) AS tool_calls_total,
         CAST(coalesce(a.attachment_total, 0) AS BIGINT) AS attachment_total,
         CAST(coalesce(a.file_total, 0) AS BIGINT) AS file_total,
         coalesce(a.has_thinking, FALSE) AS has_thinking,
         CAST(coalesce(a.human_turn_count, 0) AS BIGINT) AS human_turn_count,
         CAST(coalesce(a.assistant_turn_count, 0) AS BIGINT) AS assistant_turn_count,
         coalesce(a.has_fork, FALSE) AS has_fork,
         CAST(coalesce(a.fork_count, 0) AS BIGINT) AS fork_count,
         CAST(coalesce(a.human_fork_count, 0) AS BIGINT) AS human_fork_count,
         CAST(coalesce(a.assistant_fork_count, 0) AS BIGINT) AS assistant_fork_count,
         CAST(coalesce(a.inplace_edit_count, 0) AS BIGINT) AS inplace_edit_count,
         CAST(coalesce(a.root_count, 0) AS BIGINT) AS root_count
  FROM conv c
  LEFT JOIN (
    SELECT conversation_uuid, min(created_at) AS first_msg_at, max(created_at) AS last_msg_at,
           sum(CASE WHEN sender='human' THEN chars_text ELSE 0 END) AS chars_human,
           sum(CASE WHEN sender='assistant' THEN chars_text ELSE 0 END) AS chars_assistant,
           sum(CASE WHEN sender='human' THEN tokens_text ELSE 0 END) AS tokens_human,
           sum(CASE WHEN sender='assistant' THEN tokens_text ELSE 0 END) AS tokens_assistant,
           sum(chars_thinking) AS chars_thinking_total, sum(tokens_thinking) AS tokens_thinking_total,
           sum(attachment_count) AS attachment_total, sum(file_count) AS file_total,
           bool_or(chars_thinking > 0) AS has_thinking,
           sum(CASE WHEN sender='human' THEN 1 ELSE 0 END) AS human_turn_count,
           sum(CASE WHEN sender='assistant' THEN 1 ELSE 0 END) AS assistant_turn_count,
           bool_or(fork_parent_flag) AS has_fork,
           sum(CASE WHEN fork_parent_flag THEN 1 ELSE 0 END) AS fork_count,
           sum(CASE WHEN fork_parent_flag AND sender='assistant' THEN 1 ELSE 0 END) AS human_fork_count,
           sum(CASE WHEN fork_parent_flag AND sender='human' THEN 1 ELSE 0 END) AS assistant_fork_count,
           sum(CASE WHEN inplace_edit_flag THEN 1 ELSE 0 END) AS inplace_edit_count,
           sum(CASE WHEN is_root THEN 1 ELSE 0 END) AS root_count
    FROM sm GROUP BY 1) a USING (conversation_uuid)
  LEFT JOIN tcc t USING (conversation_uuid))
"""


def wrap(body: str, tz: str = TZ) -> str:
    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM ({body}) q_"
    return f"WITH {ctes(tz)}\n{body}"
