"""Text functions of records and log lines; strings and patterns of the log format are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Logger name parts of the tracked sources, in order of precedence.
SOURCES = {
    "yesimbot": ["yesimbot", "[聊天模型]", "[心跳处理器]", "[请求执行器]", "[智能体核心]", "[世界状态]", "[L1 记忆]", "[L2-语义记忆]", "[刺激调度器]"],
    "image-generator": ["aka-ai-image-generator", "UsageReporter", "ImageGeneration"],
    "chat-luna": ["chatluna", "chat-luna"],
}
# Fixed value: names of daily log files.
LOG_FILE = r"^(\d{4})-(\d{2})-(\d{2})-(\d+)\.log$"


def infer_source(name: Column) -> Column:
    """The tracked source that a logger name belongs to, else null."""
    found = F.lit(None).cast("string")
    for source, parts in reversed(SOURCES.items()):
        found = F.when(reduce(lambda a, b: a | b, [name.contains(p) for p in parts]), F.lit(source)).otherwise(found)
    return found


def strip_ansi(content: Column) -> Column:
    return F.regexp_replace(content, r"\x1b\[[0-9;]*m", "")


def infer_provider_model(model: Column) -> Column:
    """The provider of a chat model by its name."""
    return (
        F.when(model.contains("kimi") | model.contains("gpt"), "cpa")
        .when(model.contains("deepseek"), "deepseek")
        .when(model.contains("gemini"), "yunwu")
    )


def infer_provider_chat(model: Column) -> Column:
    """The provider of a model mentioned by an adapter."""
    return (
        F.when(model.contains("deepseek"), "deepseek")
        .when(model.contains("yunwu") | model.contains("gemini"), "yunwu")
        .when(model.contains("ollama"), "ollama")
        .when(model.contains("openai"), "openai")
    )


def last_segment(model: Column) -> Column:
    """What follows the last slash; the whole where that is empty."""
    return F.coalesce(F.nullif(F.substring_index(model, "/", -1), F.lit("")), model)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: a character beyond U+FFFF has four bytes in UTF-8 and counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def first_name(*candidates: Column) -> Column:
    """The first candidate that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("")) for c in candidates])


def log_file_key(name: Column) -> Column:
    """A struct that orders log files by date, then by number; other names come first."""
    part = lambda i: F.regexp_extract(name, LOG_FILE, i)
    known = name.rlike(LOG_FILE)
    return F.struct(
        F.when(known, F.concat(part(1), part(2), part(3)).try_cast("int")).otherwise(0).alias("date_num"),
        F.when(known, part(4).try_cast("long")).otherwise(0).alias("seq"),
        name.alias("name"),
    )
