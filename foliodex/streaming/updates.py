"""Update messages: rows of an opcode and JSON data, as events of a text stream and as words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The opcodes, and the words for each; braces name a value of the data and what stands for a missing one.
WORDS = {
    "file_parsing": "Parsing {filename}...",
    "file_parsed": "Parsed {filename}",
    "file_summarizing": "Summarizing {filename}...",
    "file_summarized": "Summarized {filename}",
    "file_embedding": "Embedding {filename}...",
    "file_embedded": "Embedded {filename}",
    "file_complete": "Completed {filename}",
    "file_failed": "Failed {filename}: {error}",
    "file_skipped": "Skipped {filename}: {reason}",
    "file_created": "Created {path}",
    "file_modified": "Modified {path}",
    "file_deleted": "Deleted {path}",
    "file_moved": "Moved {src_path} -> {dest_path}",
    "watch_added": "Added watch directory",
    "watch_removed": "Removed watch directory",
    "watch_started": "Started watching for changes",
    "directory_processing_started": "Processing directory: {path}",
    "directory_processing_completed": "Completed directory: {path}",
    "status_update": "Status: {message:Status update}",
    "error": "Error: {message:Error occurred}",
    "info": "Info: {message:Info}",
    "shutting_down": "Server shutting down",
}
MISSING = {"filename": "Unknown file", "error": "Unknown error", "reason": "Unknown reason", "path": "Unknown path", "src_path": "Unknown source", "dest_path": "Unknown destination"}


def update_rows(df: DataFrame, opcode: Column, **data: str) -> DataFrame:
    """``df`` with ``opcode`` and ``data``, a JSON object of the named columns; null values are left out."""
    return df.withColumn("opcode", opcode).withColumn("data", F.to_json(F.struct(*(F.col(c).alias(k) for k, c in data.items()))))


def message(opcode: Column, data: Column) -> Column:
    """An update in words."""
    import re

    said = None
    for code, words in WORDS.items():
        parts = []
        for literal, name, default in re.findall(r"([^{]+)|\{(\w+)(?::([^}]*))?\}", words):
            parts.append(F.lit(literal) if literal else F.coalesce(F.get_json_object(data, f"$.{name}"), F.lit(default or MISSING.get(name, ""))))
        said = F.when(opcode == code, F.concat(*parts)) if said is None else said.when(opcode == code, F.concat(*parts))
    return said.otherwise(F.concat(F.lit("Unknown update: "), opcode))


def event_text(event: Column, data: Column, event_id: Column | None = None) -> Column:
    """An event of a text stream: its name, its id, a data line for each line of the data, and a blank line."""
    lines = F.array_join(F.transform(F.split(data, r"\r\n|\r|\n"), lambda x: F.concat(F.lit("data: "), x)), "\n")
    named = F.when(event != "", F.concat(F.lit("event: "), event))
    numbered = F.when(event_id.isNotNull(), F.concat(F.lit("id: "), event_id.cast("string"))) if event_id is not None else F.lit(None).cast("string")
    return F.concat(F.concat_ws("\n", named, numbered, lines), F.lit("\n\n"))


def parsed_event(event: Column) -> Column:
    """opcode and data of a text event; an unknown opcode or data that is no JSON object is info with the text as message."""
    data = F.array_join(F.transform(F.filter(F.split(event, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    opcode = F.get_json_object(data, "$.opcode")
    known = F.coalesce(opcode.isin(list(WORDS)), F.lit(False))
    plain = F.to_json(F.struct(data.alias("message")))
    return F.struct(F.when(known, opcode).otherwise("info").alias("opcode"), F.when(known, F.coalesce(F.get_json_object(data, "$.data"), F.lit("{}"))).otherwise(plain).alias("data"))
