from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class Tables:
    """Normalised input tables every report reads.

    conversations  conversation_uuid, name, created_at, message_count
    messages       message_uuid, conversation_uuid, parent_message_uuid, sender, position,
                   created_at, updated_at, text, thinking, chars_text, chars_thinking,
                   attachment_count, file_count
    tool_calls     conversation_uuid, message_uuid, name, input, start_timestamp, duration_s
    tool_results   conversation_uuid, message_uuid, name, is_error, texts (ARRAY<STRING>)
    citations      conversation_uuid, message_uuid, cite_type, url, domain, cited_at
    projects       project_uuid, name, description, prompt_template, is_private,
                   is_starter_project, created_at
    docs           doc_uuid, project_uuid, content_length
    attachments    message_uuid, position, file_name, file_size, file_type, content_length
    files          message_uuid, position, file_uuid, file_name
    blocks         message_uuid, position, type  (content blocks; export only)

    Inputs that a source does not carry are None; reports that need them are skipped.
    """

    conversations: DataFrame
    messages: DataFrame
    tool_calls: DataFrame | None = None
    tool_results: DataFrame | None = None
    citations: DataFrame | None = None
    projects: DataFrame | None = None
    docs: DataFrame | None = None
    attachments: DataFrame | None = None
    files: DataFrame | None = None
    blocks: DataFrame | None = None
    users: DataFrame | None = None
