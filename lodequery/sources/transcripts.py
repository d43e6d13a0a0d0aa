"""Turns from logs of JSON lines, one event a line, in two dialects; and the sessions they belong to.

Lines are rows (session_key, line, value). Blank lines and lines that aren't JSON objects are skipped; a null value is a
blank line; empty tables give empty results; equal line numbers within a session make the order of their turns undefined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Roles that speak, blocks with text, and the second dialect's events.
ROLES, BLOCKS = ("user", "assistant"), ("text", "thinking")
EVENT_ROLES, START = {"user.message": "user", "assistant.message": "assistant"}, "session.start"


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all .jsonl files below a path: session_key (the file's name), line (place in the file, by byte order) and value.

    A file is one session and is read whole by one task, as its lines must be numbered.
    """
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1)
    return whole.select(name.alias("session_key"), F.posexplode(F.split("value", "\n")).alias("line", "value"))


def events(lines: DataFrame) -> DataFrame:
    """Lines that hold a JSON object, with it as `e`; what follows the object must end in a brace, or the line is skipped."""
    return lines.withColumn("e", F.try_parse_json("value")).where(F.col("e").isNotNull() & F.rlike("value", F.lit(r"(?s)^\s*\{.*\}\s*$")))


def text_at(path: str) -> Column:
    """The value at a path of the event if it is a text; null for others."""
    value = F.try_variant_get("e", path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get("e", path, "string"))


def epoch(raw: Column) -> Column:
    """Seconds since 1970 of an ISO timestamp; null where it can't be read."""
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(raw, "Z$", "+00:00"))) / 1e6


def message_text(text: Column, blocks: Column) -> Column:
    """The message's text, or the text of its blocks (type, text, thinking) of the known kinds, joined by line feeds."""
    of = lambda b: F.when(b["type"] == BLOCKS[0], b[BLOCKS[0]]).when(b["type"] == BLOCKS[1], b[BLOCKS[1]])
    parts = F.filter(F.transform(blocks, of), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(text, F.array_join(parts, "\n"), F.lit(""))


def numbered(rows: DataFrame) -> DataFrame:
    """Accepted turns numbered from 0 within their session."""
    index = F.row_number().over(Window.partitionBy("session_key").orderBy("line")) - 1
    return rows.withColumn("turn_index", index).select("session_key", "turn_index", "role", "text", "ts")


def message_turns(lines: DataFrame) -> DataFrame:
    """Turns of the first dialect: events of a speaking type with a message of a speaking role and some text."""
    blocks = F.from_json(F.try_variant_get("e", "$.message.content", "variant").cast("string"), "array<struct<type string, text string, thinking string>>")
    rows = events(lines).select("session_key", "line", text_at("$.type").alias("type"), text_at("$.message.role").alias("role"), text_at("$.timestamp").alias("raw"), text_at("$.message.content").alias("content"), blocks.alias("blocks"))
    rows = rows.where(F.col("type").isin(*ROLES) & F.col("role").isin(*ROLES)).withColumn("text", message_text(F.col("content"), F.when(F.col("content").isNull(), F.col("blocks"))))
    return numbered(rows.where("text <> ''").withColumn("ts", epoch(F.col("raw"))))


def event_turns(lines: DataFrame) -> DataFrame:
    """Turns of the second dialect: message events with a content that isn't blank, stripped."""
    role = F.coalesce(*(F.when(text_at("$.type") == k, F.lit(v)) for k, v in EVENT_ROLES.items()))
    rows = events(lines).select("session_key", "line", role.alias("role"), F.regexp_replace(text_at("$.data.content"), r"^\s+|\s+$", "").alias("text"), text_at("$.timestamp").alias("raw"))
    return numbered(rows.where("role is not null and text <> ''").withColumn("ts", epoch(F.col("raw"))))


def session_contexts(lines: DataFrame) -> DataFrame:
    """session_key, cwd and git_root of each session's first start event; null where it has none."""
    rows = events(lines).where(text_at("$.type") == START).select("session_key", "line", F.nullif(text_at("$.data.context.cwd"), F.lit("")).alias("cwd"), F.nullif(text_at("$.data.context.gitRoot"), F.lit("")).alias("git_root"))
    first = rows.groupBy("session_key").agg(F.min_by(F.struct("cwd", "git_root"), "line").alias("c"))
    return first.select("session_key", "c.cwd", "c.git_root")


def within(child: Column, parent: Column) -> Column:
    """Whether a path is another or lies below it."""
    plain = lambda c: F.when(c == "/", c).otherwise(F.regexp_replace(F.regexp_replace(c, r"/(?:\./)*(?:\.$)?", "/"), "(?<=.)/+$", ""))
    return (plain(child) == plain(parent)) | F.startswith(plain(child), F.concat(F.regexp_replace(plain(parent), "/$", ""), F.lit("/")))


def of_project(contexts: DataFrame, project: str) -> DataFrame:
    """Sessions begun inside the project, or in a repository that holds it."""
    own = F.lit(project)
    return contexts.where(F.coalesce(within(F.col("cwd"), own), F.lit(False)) | F.coalesce(within(own, F.col("git_root")), F.lit(False)))


def encoded_path(path: Column) -> Column:
    """A project's path as a folder name."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")
