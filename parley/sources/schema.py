"""Explicit schemas of the chat export (three top-level JSON arrays).

Content blocks are polymorphic by `type`; they are read as raw JSON text (ARRAY<STRING>:
the JSON reader hands back each element's text when the declared type is STRING) and
parsed per field later, so unknown block types and extra fields never break the read.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _s(*fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


ATTACHMENT = _s(("file_name", StringType()), ("file_size", LongType()), ("file_type", StringType()),
                ("extracted_content", StringType()))
FILE = _s(("file_uuid", StringType()), ("file_name", StringType()))
MESSAGE = _s(
    ("uuid", StringType()), ("parent_message_uuid", StringType()), ("sender", StringType()),
    ("created_at", TimestampType()), ("updated_at", TimestampType()), ("text", StringType()),
    ("content", ArrayType(StringType())), ("attachments", ArrayType(ATTACHMENT)), ("files", ArrayType(FILE)),
)
CONVERSATION = _s(
    ("uuid", StringType()), ("name", StringType()), ("summary", StringType()),
    ("created_at", TimestampType()), ("updated_at", TimestampType()),
    ("account", _s(("uuid", StringType()))), ("chat_messages", ArrayType(MESSAGE)),
)
DOC = _s(("uuid", StringType()), ("filename", StringType()), ("content", StringType()),
         ("created_at", TimestampType()))
PROJECT = _s(
    ("uuid", StringType()), ("name", StringType()), ("description", StringType()),
    ("prompt_template", StringType()), ("is_private", BooleanType()), ("is_starter_project", BooleanType()),
    ("created_at", TimestampType()), ("updated_at", TimestampType()),
    ("creator", _s(("uuid", StringType()), ("full_name", StringType()))), ("docs", ArrayType(DOC)),
)
USER = _s(("uuid", StringType()), ("full_name", StringType()), ("email_address", StringType()),
          ("verified_phone_number", StringType()))

# Fields read from one content block (DDL for from_json). Object-valued fields declared as
# STRING come back as their raw JSON text.
BLOCK_DDL = (
    "type STRING, text STRING, thinking STRING, start_timestamp STRING, stop_timestamp STRING, "
    "id STRING, name STRING, integration_name STRING, is_mcp_app BOOLEAN, mcp_server_url STRING, "
    "input STRING, tool_use_id STRING, is_error BOOLEAN, content STRING, structured_content STRING, "
    "citations STRING"
)
RESULT_CONTENT_DDL = "ARRAY<STRUCT<type: STRING, text: STRING>>"
CITATIONS_DDL = "ARRAY<STRUCT<details: STRUCT<type: STRING, url: STRING>>>"
