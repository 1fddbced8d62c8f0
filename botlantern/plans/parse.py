"""From log lines to AI-request and image-generation records, as one batch plan.

Lines have a stream (one bot's log), a file, an offset in it and a value (JSON). Their total order is
by file key, then offset. What a sequential parser would remember becomes windows:

- ends of chat calls take the latest start of their model since its last end;
- image outcomes take the latest request of their provider since its last success;
- image outcomes take the latest command, token usage the latest model mention of the stream.

Each of these carries a value forward in two steps: inside each file, then over one row for each file
and key. So no window grows with what one bot, model or provider says, only with its files.

Only lines that matter to a step go through it, so windows see a small part of the log.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config
from ..functions import day_of_ms, first_filled, hour_of_ms, infer_provider_chat, infer_provider_model, infer_source, instant_of_ms, last_segment, log_file_key, strip_ansi, utf16_length

# Marks of the log format.
CHAT_NAME = r"^\[聊天模型\] \[([^\]]+)\]"
EXECUTOR_NAME = r"^\[请求执行器\]\[chat\]:\[([^\]]+)\]"
WORLD_STATE = "[世界状态]"
CHAT_START = "请求开始"
FIRST_TOKEN = r"🌊 流式传输已开始 \| 延迟: (\d+)ms"
CHAT_FINISH = r"🏁 \[流式\] 传输完成 \| 总耗时: (\d+)ms \| 输入: (\d+) \| 输出: (\d+)"
CHAT_EMPTY = ("模型未输出有效内容", "OUTPUT_EMPTY_CONTENT")
REQUEST_FAILED = "请求失败"
REQUEST_ERROR = r"错误: (.+)\z"
MODEL_MENTION = r"(?i)(?:Create summary model|使用模型|model)\s*[:：]\s*([^\n\r,]+)"
ADAPTER_MENTION = r"(?i)(?:currentModel|selected model|modelId)\s*[:=]\s*([A-Za-z0-9_./:-]+)"
TOKEN_USAGE = r"(?i)Token usage from API:\s*input\s*=\s*(\d+)\s+output\s*=\s*(\d+)\s+total\s*=\s*(\d+)"
COMMAND_CONTEXT = r"记录指令调用 \| 用户: ([^|]+) \| 指令: ([^|]+) \| 频道: ([a-z]+):"
IMAGE_LOGGER = "aka-ai-image-generator"
IMAGE_REQUEST = "requestProviderImages 调用"
IMAGE_EVENT = r"provider=(\S+) event=(\S+)"
IMAGE_SUCCESS = ("create_success", "edit_success", "generate_success")
IMAGE_FAILURE = ("generate_failed", "create_failed", "edit_failed")
#: How long context stays fresh, in ms.
COMMAND_TTL = 120_000
MODEL_TTL = 300_000
#: Beyond every offset: lines that are carried on stand this far before those of their file.
CARRIED = 1 << 53


@dataclass(frozen=True)
class ParsedLogs:
    ai: DataFrame
    images: DataFrame
    outcomes: DataFrame
    #: Events that say something to a parser; kept ones are the caller's to unpersist.
    known: DataFrame


def _once(value: Column) -> Column:
    """A column that is computed in a step of its own: filters and other columns that use it don't repeat it."""
    return F.explode_outer(F.array(value))


def strict_json(text: Column) -> Column:
    """A JSON text as an array variant with its one value; null unless it is one value from end to end.

    Spark's parser stops after a value. Inside brackets of ours it stops too early only at a closing
    bracket of the text's own, so texts that have one are parsed between braces, too: what is behind a
    value can't go on as a list and as an object. Of repeated keys the last counts, as long as the session
    allows them (`events_of` sees to it). Values nested deeper than 1000 levels, numbers of over 1000 digits
    and lines of over 128 MB are no JSON here.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = lambda v: F.variant_get(v, "$[0]", "variant").isNotNull() & F.variant_get(v, "$[1]", "variant").isNull()
    return F.element_at(F.transform(F.array(listed), lambda v: F.when(one(v) & (~text.contains("]") | held.isNotNull()), v)), 1)


def _field(listed: Column, name: str, kinds: str, to: str) -> Column:
    """A field of the one value, if it has one of some kinds: a variant's other values would be cast."""
    found = F.variant_get(listed, f"$[0].{name}", "variant")
    return F.when(F.schema_of_variant(found).rlike(kinds), F.try_variant_get(listed, f"$[0].{name}", to))


def _group(content: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(content, pattern, i)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def events_of(lines: DataFrame) -> DataFrame:
    """Lines with status, name, content and ts (ms); a line without its three fields has no content.

    Status: invalid is no JSON; other is no object; else object.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    found = lines.select("*", _once(strict_json(F.col("value"))).alias("_json"))
    # JSON tells its kind by its first character.
    status = F.when(F.col("_json").isNull(), "invalid").when(F.col("value").rlike(r"^[ \t\n\r]*\{"), "object").otherwise("other")
    fields = [_field(F.col("_json"), *f).alias(f[0]) for f in (("name", "^STRING", "string"), ("content", "^STRING", "string"), ("timestamp", "^(BIGINT|DOUBLE|DECIMAL)", "double"))]
    found = found.select(*lines.columns, status.alias("status"), _once(F.when(status == "object", F.struct(*fields))).alias("_e"))
    ts = F.col("_e.timestamp").try_cast("long")
    filled = (F.col("_e.name") != "") & (F.col("_e.content") != "") & (F.col("_e.timestamp") != 0) & ts.isNotNull()
    event = F.when(filled, F.struct(F.col("_e.name"), F.col("_e.content"), ts.alias("ts")))
    return found.select(*lines.columns, "status", _once(event).alias("_e")).select(*lines.columns, "status", "_e.name", "_e.content", "_e.ts")


def classified(events: DataFrame, config: Config) -> DataFrame:
    """Events with kind: what a line says to the parsers, null if nothing."""
    tracked = [s for s, on in config.tracked_sources.items() if on]
    events = events.withColumn("source", infer_source(F.col("name"))).withColumn("clean", strip_ansi(F.col("content")))
    source = F.when(F.col("source").isin(tracked), F.col("source")) if tracked else F.lit(None).cast("string")
    name, content, clean = F.col("name"), F.col("content"), F.col("clean")
    ai, images = F.lit(config.enable_ai_stats), F.lit(config.enable_image_stats)
    chat = (source == "yesimbot") & ai & name.rlike(CHAT_NAME)
    executor = (source == "yesimbot") & ai & name.rlike(EXECUTOR_NAME) & ~name.rlike(CHAT_NAME)
    luna = (source == "chat-luna") & ai & name.contains("chatluna")
    image = (source == "image-generator") & images & name.startswith(IMAGE_LOGGER)
    outcome = _group(clean, IMAGE_EVENT, 2)
    is_request = image & clean.contains(IMAGE_REQUEST)
    kind = (
        F.when((source == "yesimbot") & images & name.startswith(WORLD_STATE) & clean.rlike(COMMAND_CONTEXT), "command")
        .when(chat & content.contains(CHAT_START), "start")
        .when(chat & content.rlike(FIRST_TOKEN), "first")
        .when(chat & content.rlike(CHAT_FINISH), "finish")
        .when(chat & (content.contains(CHAT_EMPTY[0]) | content.contains(CHAT_EMPTY[1])), "empty")
        .when(executor & content.contains(REQUEST_FAILED), "failed")
        .when(luna & (clean.rlike(MODEL_MENTION) | clean.rlike(ADAPTER_MENTION)), "model")
        .when(luna & clean.rlike(TOKEN_USAGE), "usage")
        .when(is_request, "image_request")
        .when(image & outcome.isin(*IMAGE_SUCCESS), "image_ok")
        .when(image & outcome.isin(*IMAGE_FAILURE), "image_failed")
    )
    return events.select("*", _once(kind).alias("kind"))


_ORDER = ["file_key", "offset"]


def carry_forward(rows: DataFrame, values: dict[str, Column], keys: tuple[str, ...] = ("stream",), current: bool = True) -> DataFrame:
    """Adds each named value as it was last not null among the rows of equal keys: up to this row, or before it.

    A value should be a struct, so that one with a null field can take back an earlier one.
    """
    rows = rows.withColumns({f"_own_{n}": v for n, v in values.items()})
    inside = Window.partitionBy(*keys, "file_key").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    rows = rows.withColumns({f"_local_{n}": F.last(f"_own_{n}", ignorenulls=True).over(inside) for n in values})
    last = [F.max_by(f"_own_{n}", F.when(F.col(f"_own_{n}").isNotNull(), F.col("offset"))).alias(f"_last_{n}") for n in values]
    files = rows.groupBy(*keys, "file_key").agg(*last)
    # One row for each file and key.
    before = Window.partitionBy(*keys).orderBy("file_key").rowsBetween(Window.unboundedPreceding, -1)
    inherited = files.select(*keys, "file_key", *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_inherited_{n}") for n in values])
    joined = rows.join(inherited, [*keys, "file_key"], "left")
    for n in values:
        joined = joined.withColumn(n, F.coalesce(f"_local_{n}", f"_inherited_{n}")).drop(f"_own_{n}", f"_local_{n}", f"_inherited_{n}")
    return joined


def _request_id(ts: Column, model: Column, content: Column) -> Column:
    return F.concat_ws("-", F.lit("yes"), ts, model, utf16_length(content))


def _typed(rows: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, in order; those missing are null."""
    columns = []
    for part in ddl.split(", "):
        name, kind = part.split(" ")
        columns.append((F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name))
    return rows.select(*columns)


def _place() -> list[Column]:
    """The line that a record is made of."""
    return [F.col("file_key.name").alias("logFile"), F.col("offset").alias("logOffset")]


def chat_requests(events: DataFrame) -> DataFrame:
    """Ends of chat calls with what their start and first token lines said."""
    is_start, is_end = F.col("kind") == "start", F.col("kind").isin("finish", "empty")
    rows = events.where(F.col("kind").isin("start", "first", "finish", "empty"))
    rows = rows.select("stream", "file_key", "offset", "kind", "ts", "content", _group(F.col("name"), CHAT_NAME, 1).alias("model"))
    # A start takes back an earlier first token, an end both.
    start = F.when(is_start | is_end, F.struct(F.when(is_start, F.col("ts")).alias("ts"), F.when(is_start, F.col("content")).alias("content")))
    first = F.struct(F.when(F.col("kind") == "first", _group(F.col("content"), FIRST_TOKEN, 1).cast("long")).alias("ms"))
    pairs = carry_forward(rows, {"start": start, "first": first}, ("stream", "model"), current=False).where(is_end)
    of = lambda c: F.coalesce(F.col(f"start.{c}"), F.col(c))
    done = F.col("kind") == "finish"
    number = lambda i: _group(F.col("content"), CHAT_FINISH, i).try_cast("long")
    tokens = lambda i: F.when(done, number(i)).otherwise(F.lit(0))
    return pairs.select(
        _request_id(of("ts"), F.col("model"), of("content")).alias("id"),
        of("ts").alias("ts"),
        F.lit("yesimbot").alias("source"),
        infer_provider_model(F.col("model")).alias("provider"),
        F.col("model").alias("modelId"),
        tokens(2).alias("promptTokens"),
        tokens(3).alias("completionTokens"),
        (tokens(2) + tokens(3)).alias("totalTokens"),
        F.when(done, number(1)).alias("latencyMs"),
        F.when(F.col("start.ts").isNotNull(), F.col("first.ms")).alias("firstTokenLatencyMs"),
        done.alias("success"),
        F.when(~done, F.lit("OUTPUT_EMPTY_CONTENT")).alias("errorCode"),
        *_place(),
    )


def failed_requests(events: DataFrame) -> DataFrame:
    model = _group(F.col("name"), EXECUTOR_NAME, 1)
    error = F.substring(_trimmed(_group(F.col("content"), REQUEST_ERROR, 1)), 1, 100)
    zero = F.lit(0).cast("long")
    return events.where("kind = 'failed'").select(
        _request_id(F.col("ts"), model, F.col("content")).alias("id"),
        "ts",
        F.lit("yesimbot").alias("source"),
        infer_provider_model(model).alias("provider"),
        model.alias("modelId"),
        zero.alias("promptTokens"),
        zero.alias("completionTokens"),
        zero.alias("totalTokens"),
        F.lit(False).alias("success"),
        F.when(F.col("content").rlike(REQUEST_ERROR), error).otherwise("UNKNOWN").alias("errorCode"),
        *_place(),
    )


def mentioned_model(clean: Column) -> Column:
    return F.when(clean.rlike(MODEL_MENTION), _trimmed(_group(clean, MODEL_MENTION, 1))).otherwise(_group(clean, ADAPTER_MENTION, 1))


def usage_requests(events: DataFrame, config: Config) -> DataFrame:
    rows = events.where(F.col("kind").isin("model", "usage")).select("stream", "file", "file_key", "offset", "kind", "ts", "clean")
    rows = carry_forward(rows, {"mention": F.when(F.col("kind") == "model", F.struct(mentioned_model(F.col("clean")).alias("model"), "ts"))})
    usage = rows.where("kind = 'usage'")
    fresh = F.col("ts") - F.col("mention.ts") < MODEL_TTL
    model = first_filled(F.when(fresh, F.col("mention.model")), F.lit(config.default_model).cast("string"), F.lit("unknown"))
    usage = usage.withColumn("model", model)
    number = lambda i: _group(F.col("clean"), TOKEN_USAGE, i).try_cast("long")
    return usage.select(
        F.concat_ws("-", F.lit("cl"), "ts", "model", number(1), number(2)).alias("id"),
        "ts",
        F.lit("chatluna").alias("source"),
        infer_provider_chat(F.col("model")).alias("provider"),
        last_segment(F.col("model")).alias("modelId"),
        number(1).alias("promptTokens"),
        number(2).alias("completionTokens"),
        number(3).alias("totalTokens"),
        F.lit(True).alias("success"),
        *_place(),
    )


def image_outcomes(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("kind").isin("command", "image_request", "image_ok", "image_failed"))
    rows = rows.select("stream", "file", "file_key", "offset", "kind", "ts", "clean")
    part = lambda i: _trimmed(_group(F.col("clean"), COMMAND_CONTEXT, i))
    context = F.struct(part(1).alias("user"), part(2).alias("command"), part(3).alias("platform"), "ts")
    rows = carry_forward(rows, {"context": F.when(F.col("kind") == "command", context)}).where("kind <> 'command'")
    provider = F.when(F.col("kind") == "image_request", first_filled(_group(F.col("clean"), r"provider: '([^']+)'", 1), F.lit("unknown"))).otherwise(_group(F.col("clean"), IMAGE_EVENT, 1))
    rows = rows.withColumn("provider", provider)
    is_request = F.col("kind") == "image_request"
    asked = F.struct(F.when(is_request, F.nullif(_group(F.col("clean"), r"modelId: '([^']+)'", 1), F.lit(""))).alias("model"), F.when(is_request, _group(F.col("clean"), r"numImages: (\d+)", 1).try_cast("long")).alias("n"))
    rows = carry_forward(rows, {"asked": F.when(F.col("kind").isin("image_request", "image_ok"), asked)}, ("stream", "provider"), current=False).where(~is_request)
    ok = F.col("kind") == "image_ok"
    fresh = F.col("ts") - F.col("context.ts") < COMMAND_TTL
    n = F.col("asked.n")
    zero = F.lit(0).cast("long")
    return rows.select(
        F.concat_ws("-", F.lit("img"), "ts", "provider", F.when(ok, "ok").otherwise("fail")).alias("id"),
        "ts",
        F.when(fresh, F.col("context.user")).alias("userId"),
        F.when(fresh, F.col("context.platform")).alias("platform"),
        F.when(fresh, F.col("context.command")).alias("commandName"),
        F.col("asked.model").alias("modelId"),
        "provider",
        F.when(n > 0, n).otherwise(F.lit(1)).alias("numImages"),
        ok.alias("success"),
        zero.alias("freeUsed"),
        zero.alias("purchasedUsed"),
        F.lit("unknown").alias("consumptionType"),
        F.when(~ok, F.substring("clean", 1, 100)).alias("errorCode"),
        *_place(),
    )


def open_lines(known: DataFrame) -> DataFrame:
    """The lines (stream, file, offset, value) that records of later lines may need, none of which makes one itself.

    Of each model the start without an end and its first token; of each provider the last request
    without a success; of each stream the last model mention and the last command, unless by the stream's
    last line they are no longer fresh. So there are four lines for each key at most, however long the log is.
    `known`: events with a kind. A line is written anew from its three fields. It keeps its file, and its
    offset comes before all that a file can have: what a file that was cut short or written anew says
    later is behind it, too.
    """
    kind = F.col("kind")
    chat, image = kind.isin("start", "first", "finish", "empty"), kind.isin("image_request", "image_ok")
    rows = known.where(chat | image | kind.isin("model", "command"))
    provider = F.when(kind == "image_request", first_filled(_group(F.col("clean"), r"provider: '([^']+)'", 1), F.lit("unknown"))).otherwise(_group(F.col("clean"), IMAGE_EVENT, 1))
    key = F.when(chat, _group(F.col("name"), CHAT_NAME, 1)).when(image, provider).otherwise("")
    group = F.when(chat, "chat").when(image, "image").otherwise(kind)
    value = F.to_json(F.struct("name", "content", F.col("ts").alias("timestamp")))
    rows = rows.select("stream", group.alias("group"), key.alias("key"), "kind", F.struct(*_ORDER, "file", "ts", value.alias("value")).alias("line"))
    last = lambda *kinds: F.max(F.when(kind.isin(*kinds), F.col("line")))
    ends = rows.groupBy("stream", "group", "key").agg(
        last("start").alias("start"), last("first").alias("first"), last("finish", "empty").alias("end"),
        last("image_request").alias("asked"), last("image_ok").alias("done"), last("model", "command").alias("context"), F.max(F.struct("line.file_key", "line.offset", "line.ts")).alias("newest"),
    )
    # One row for each key.
    ends = ends.withColumn("now", F.max("newest").over(Window.partitionBy("stream"))["ts"])
    after = lambda a, b: F.col(b).isNull() | (F.col(a) > F.col(b))
    fresh = F.col("now") - F.col("context.ts") < F.when(F.col("group") == "command", COMMAND_TTL).otherwise(MODEL_TTL)
    kept = [F.when(after("start", "end"), F.col("start")), F.when(after("start", "end") & (F.col("first") > F.col("start")), F.col("first")), F.when(after("asked", "done"), F.col("asked")), F.when(fresh, F.col("context"))]
    lines = ends.select("stream", F.explode(F.array(*kept)).alias("line")).where("line is not null")
    offset = F.col("line.offset")
    return lines.select("stream", "line.file", F.when(offset < 0, offset).otherwise(offset - CARRIED).alias("offset"), "line.value")


def outcome_of(status: Column, kind: Column) -> Column:
    """What became of a line: invalid, ai, image or ignored."""
    return (
        F.when(status == "invalid", "invalid")
        .when(kind.isin("finish", "empty", "failed", "usage"), "ai")
        .when(kind.isin("image_ok", "image_failed"), "image")
        .otherwise("ignored")
    )


def on_disk(events: DataFrame) -> DataFrame:
    return events.persist(StorageLevel.DISK_ONLY)


def known_of(events: DataFrame) -> DataFrame:
    """Events that say something to a parser, with the place of their file."""
    return events.where("kind is not null").select("stream", "file", log_file_key(F.col("file")).alias("file_key"), "offset", "kind", "ts", "name", "content", "clean")


def records_of(known: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """AI requests and image generations of known events."""
    timed = lambda df: df.withColumn("timestamp", instant_of_ms(F.col("ts"))).withColumn("date", day_of_ms(F.col("ts"))).withColumn("hour", hour_of_ms(F.col("ts")))
    parts = [_typed(timed(df), schemas.AI_REQUEST) for df in (chat_requests(known), failed_requests(known), usage_requests(known, config))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), _typed(timed(image_outcomes(known)), schemas.IMAGE_GENERATION)


def parse_logs(lines: DataFrame, config: Config | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> ParsedLogs:
    """Records and outcome counts of lines (stream, file, offset, value).

    Records of lines that were read twice have equal ids and places; writers keep one of them. Records read the known
    events more than once; `keep` puts those where that is cheap (`on_disk`, or a stored table), and what
    it keeps is the caller's to free. Outcomes need all lines and are counted in a pass of their own.
    """
    config = config or Config()
    if "stream" not in lines.columns:
        lines = lines.withColumn("stream", F.lit(""))
    events = classified(events_of(lines), config)
    outcomes = events.groupBy(outcome_of(F.col("status"), F.col("kind")).alias("outcome")).agg(F.count("*").alias("lines"))
    known = known_of(events)
    if keep:
        known = keep(known)
    ai, images = records_of(known, config)
    return ParsedLogs(ai, images, outcomes, known)
