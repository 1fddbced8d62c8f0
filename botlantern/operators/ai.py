"""Figures of AI requests: the daily rollup and what the dashboard makes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import day_label, open_ended, ratio, whole

ROLLUP_KEY = ["date", "source", "provider", "modelId"]


def model_daily(requests: DataFrame) -> DataFrame:
    """Requests by date, source, provider and model; missing key parts are empty, missing numbers 0."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return requests.groupBy("date", blank("source"), blank("provider"), blank("modelId")).agg(
        F.count("*").alias("requestCount"),
        F.count_if(F.col("success") == F.lit(True)).alias("successCount"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("failCount"),
        F.sum(whole(F.col("promptTokens"))).alias("promptTokens"),
        F.sum(whole(F.col("completionTokens"))).alias("completionTokens"),
        F.sum(whole(F.col("totalTokens"))).alias("totalTokens"),
        F.sum(whole(F.col("latencyMs"))).alias("totalLatencyMs"),
    )


def ai_overview(daily: DataFrame, as_of: int, days: int) -> DataFrame:
    """One row of totals; the mean latency is over all requests."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = daily.where(open_ended(F.col("date"), as_of, days)).agg(*[zero(c) for c in ("requestCount", "failCount", "promptTokens", "completionTokens", "totalTokens", "totalLatencyMs")])
    return sums.select(
        F.col("requestCount").alias("total_requests"),
        F.col("promptTokens").alias("total_prompt_tokens"),
        F.col("completionTokens").alias("total_completion_tokens"),
        F.col("totalTokens").alias("total_tokens"),
        ratio(F.col("requestCount") - F.col("failCount"), F.col("requestCount")).alias("success_rate"),
        ratio(F.col("totalLatencyMs"), F.col("requestCount")).alias("avg_latency_ms"),
    )


def model_share(daily: DataFrame, as_of: int, days: int) -> DataFrame:
    """model_id, provider, request_count, token_count, percentage of all tokens; most tokens first."""
    groups = daily.where(open_ended(F.col("date"), as_of, days)).groupBy(F.col("modelId").alias("model_id"), "provider")
    sums = groups.agg(F.sum("requestCount").alias("request_count"), F.sum("totalTokens").alias("token_count"))
    total = F.sum("token_count").over(Window.partitionBy(F.lit(0)))  # over as many rows as there are models
    return sums.withColumn("percentage", ratio(F.col("token_count"), total)).orderBy(F.desc("token_count"), "model_id", "provider")


def failure_rate(daily: DataFrame, as_of: int, days: int) -> DataFrame:
    """model_id, request_count, fail_count, fail_rate over all providers."""
    sums = daily.where(open_ended(F.col("date"), as_of, days)).groupBy(F.col("modelId").alias("model_id")).agg(F.sum("requestCount").alias("request_count"), F.sum("failCount").alias("fail_count"))
    return sums.withColumn("fail_rate", ratio(F.col("fail_count"), F.col("request_count")))


def token_trend(daily: DataFrame, as_of: int, days: int) -> DataFrame:
    """date (ISO), prompt_tokens, completion_tokens, total_tokens of each day that has requests."""
    sums = daily.where(open_ended(F.col("date"), as_of, days)).groupBy("date").agg(
        F.sum("promptTokens").alias("prompt_tokens"), F.sum("completionTokens").alias("completion_tokens"), F.sum("totalTokens").alias("total_tokens")
    )
    return sums.withColumn("date", day_label(F.col("date"))).orderBy("date")


def newest(rows: DataFrame, as_of: int, days: int, limit: int) -> DataFrame:
    """The newest rows of a window, at most `limit`."""
    return rows.where(open_ended(F.col("date"), as_of, days)).orderBy(F.desc("timestamp"), "id").limit(limit)


def recent_requests(requests: DataFrame, as_of: int, days: int, limit: int = 10_000) -> DataFrame:
    return newest(requests, as_of, days, limit)


def recent_daily(daily: DataFrame, as_of: int, days: int) -> DataFrame:
    return daily.where(open_ended(F.col("date"), as_of, days))


def ai_user_rank(requests: DataFrame, as_of: int, days: int, recent_limit: int = 5000, top: int = 10) -> DataFrame:
    """user_id, user_name (not known: null), total_tokens, request_count over the newest requests."""
    needed = requests.select("id", "timestamp", "date", "userId", "totalTokens")
    users = newest(needed, as_of, days, recent_limit).where("userId is not null and userId <> ''")
    sums = users.groupBy(F.col("userId").alias("user_id")).agg(F.sum(whole(F.col("totalTokens"))).alias("total_tokens"), F.count("*").alias("request_count"))
    return sums.select("user_id", F.lit(None).cast("string").alias("user_name"), "total_tokens", "request_count").orderBy(F.desc("total_tokens"), "user_id").limit(top)


def normalised(requests: DataFrame) -> DataFrame:
    """Records as they are stored: a missing provider is empty."""
    provider: Column = F.coalesce("provider", F.lit(""))
    return requests.withColumn("provider", provider)
