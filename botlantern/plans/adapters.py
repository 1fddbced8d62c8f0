"""The engine's inputs made from the generated tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import day_number

#: Today, 2024-01-31.
AS_OF = 19753


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with date, hour and k, the number in props."""
    return with_place(table(spark, sf_dir, "events"))


def with_place(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.withColumn("date", day_number(F.col("ts"))).withColumn("hour", F.hour("ts")).withColumn("k", k)


def command_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return events(spark, sf_dir).select(
        "ts", "date", "hour", F.col("event_type").alias("name"), F.lit("bot").alias("selfId"), u.alias("userId"),
        F.concat(F.lit("c"), u % 10).alias("channelId"), F.concat(F.lit("p"), u % 3).alias("platform"), F.lit(1).cast("long").alias("count"),
    )


def message_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(events(spark, sf_dir))


def as_messages(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "purchase"), "send").otherwise("receive")
    return e.select("ts", "date", "hour", kind.alias("type"), F.lit("bot").alias("selfId"), F.concat(F.lit("p"), F.col("user_id") % 3).alias("platform"), F.lit(1).cast("long").alias("count"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.timestamp_seconds(F.lit((AS_OF - 1) * 86400) - (F.col("c_custkey") % 5) * 43200)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), made.alias("createdAt"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    return c.select(F.col("c_custkey").alias("userId"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("profile "), "c_custkey")).alias("userName"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.timestamp_seconds(F.lit((AS_OF - 1) * 86400) - (F.col("n_nationkey") % 2) * 43200)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("guildId"), made.alias("createdAt"))


def ai_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return events(spark, sf_dir).select(
        F.concat(F.lit("yes-"), "event_id").alias("id"), F.col("ts").alias("timestamp"), "date", "hour", F.lit("yesimbot").alias("source"),
        F.when(u % 3 == 0, "cpa").when(u % 3 == 1, "deepseek").alias("provider"), F.concat(F.lit("model-"), u % 7).alias("modelId"),
        F.when(u % 11 == 0, "").otherwise(u.cast("string")).alias("userId"), F.col("k").alias("promptTokens"), u.alias("completionTokens"), (F.col("k") + u).alias("totalTokens"),
        F.floor(F.col("value") * 100).cast("long").alias("latencyMs"), (F.col("event_type") != "error").alias("success"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.col("user_id"), F.col("k")
    return events(spark, sf_dir).where("event_type in ('purchase', 'error')").select(
        F.concat(F.lit("img-"), "event_id").alias("id"), F.col("ts").alias("timestamp"), "date", "hour", u.cast("string").alias("userId"),
        F.when(u % 5 == 0, F.concat(F.lit("style "), u % 4)).when(u % 5 == 1, "").alias("styleName"),
        F.when(u % 3 == 0, F.concat(F.lit("draw "), u % 6)).when(u % 3 == 1, "").alias("commandName"),
        (k % 4).alias("numImages"), (F.col("event_type") == "purchase").alias("success"), (k % 2).alias("freeUsed"), F.when(k % 3 > 0, k % 3).alias("purchasedUsed"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: chat calls, a chat adapter, image calls, noise; a file for each day and hour half."""
    e = events(spark, sf_dir)
    u, k, kind = F.col("user_id"), F.col("k"), F.col("event_type")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    chat = F.concat(F.lit("[聊天模型] [gpt-"), u % 3, F.lit("]"))
    slot = F.col("event_id") % 10
    pick = lambda *cases: F.coalesce(*[F.when(c, v) for c, v in cases])
    name = pick(
        ((slot < 6) & kind.isin("signup", "view", "purchase", "error"), chat),
        (slot < 6, F.concat(F.lit("[请求执行器][chat]:[kimi-"), u % 2, F.lit("]"))),
        ((slot == 6), F.lit("chatluna-core")),
        ((slot == 7) & kind.isin("signup", "view"), F.lit("[世界状态]")),
        (slot.isin(7, 8), F.lit("aka-ai-image-generator")),
        (F.lit(True), F.lit("other")),
    )
    content = pick(
        ((slot < 6) & (kind == "signup"), F.concat(F.lit("🚀 [请求开始] [流式] 模型: "), k)),
        ((slot < 6) & (kind == "view"), F.concat(F.lit("🌊 流式传输已开始 | 延迟: "), k, F.lit("ms"))),
        ((slot < 6) & (kind == "purchase"), F.concat(F.lit("🏁 [流式] 传输完成 | 总耗时: "), k, F.lit("ms | 输入: "), u, F.lit(" | 输出: "), k)),
        ((slot < 6) & (kind == "error"), F.lit("💬 [流式] 模型未输出有效内容")),
        (slot < 6, F.concat(F.lit("请求失败 错误: code "), k)),
        ((slot == 6) & kind.isin("signup", "view"), F.concat(F.lit("使用模型： deepseek/m"), u % 4)),
        (slot == 6, F.concat(F.lit("Token usage from API: input="), k, F.lit(" output="), u, F.lit(" total="), k + u)),
        ((slot == 7) & kind.isin("signup", "view"), F.concat(F.lit("记录指令调用 | 用户: user"), u, F.lit(" | 指令: draw"), u % 5, F.lit(" | 频道: qq:"), k)),
        (slot.isin(7, 8) & (kind == "purchase"), F.concat(F.lit("provider=p"), u % 2, F.lit(" event=create_success"))),
        (slot.isin(7, 8) & (kind == "error"), F.concat(F.lit("provider=p"), u % 2, F.lit(" event=edit_failed"))),
        (slot.isin(7, 8), F.concat(F.lit("requestProviderImages 调用 { provider: 'p"), u % 2, F.lit("', modelId: 'm"), k, F.lit("', numImages: "), k % 3, F.lit(" }"))),
        (F.lit(True), F.lit("noise")),
    )
    whole = F.to_json(F.struct(name.alias("name"), content.alias("content"), ms.cast("double").alias("timestamp")))
    value = F.when(F.col("event_id") % 97 == 0, "not-json").when(F.col("event_id") % 89 == 0, "[1]").otherwise(whole)
    file = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), F.floor(F.col("hour") / 2) + 1, F.lit(".log"))
    return e.select(F.lit("s").alias("stream"), file.alias("file"), F.col("event_id").alias("offset"), value.alias("value"))
