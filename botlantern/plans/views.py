"""Series for charts, made of the dashboard's results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import day_label, first_filled


def bars(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Label and value for horizontal bars, the smallest first."""
    return rows.select(label, F.col(value).alias("value")).orderBy("value", F.desc(label))


def user_bars(rank: DataFrame) -> DataFrame:
    """Users by calls; one without a name goes by its id."""
    name: Column = first_filled(F.col("user_name"), F.concat(F.lit("用户 "), F.col("user_id").cast("string")))
    return rank.select(name.alias("label"), F.col("count").alias("value")).orderBy("value", "label")


def command_pie(rates: DataFrame) -> DataFrame:
    return rates.select("name", F.col("daily_rate").alias("value")).orderBy(F.desc("value"), "name")


def history_line(by_date: DataFrame, as_of: int, tab: str, period: int) -> DataFrame:
    """One point a day of the period, oldest first; `tab` is send or receive."""
    days = by_date.where(F.col("days_ago").between(1, period)).orderBy(F.desc("days_ago"))
    return days.select(day_label(F.lit(as_of) - F.col("days_ago")).alias("label"), F.col(tab).alias("value"))


def hour_bars(by_hour: DataFrame, tab: str) -> DataFrame:
    """Bars stand in the middle of their hour."""
    return by_hour.select((F.col("hour") + 0.5).alias("x"), F.round(tab, 2).alias("value")).orderBy("x")


def failure_percent(rates: DataFrame) -> DataFrame:
    return rates.select("model_id", F.round(F.col("fail_rate") * 100, 2).alias("percent")).orderBy("percent", "model_id")


def failure_ratio(rates: DataFrame) -> DataFrame:
    """Shares from 0 to 1, the largest first."""
    return rates.select("model_id", F.round("fail_rate", 4).alias("ratio")).orderBy(F.desc("ratio"), "model_id")


# Weekdays from Sunday on, and what stands before them.
WEEK, WEEKDAY = "日一二三四五六", "星期"


def hour_tips(by_hour: DataFrame, tab: str) -> DataFrame:
    """The span of each hour and its messages a day."""
    span = F.concat(F.col("hour"), F.lit(":00-"), F.col("hour") + 1, F.lit(":00"))
    return by_hour.orderBy("hour").select(span.alias("label"), F.round(tab, 1).alias("value"))


def history_tips(line: DataFrame) -> DataFrame:
    """Points of a history line with their weekday's name."""
    return line.withColumn("weekday", F.concat(F.lit(WEEKDAY), F.substring(F.lit(WEEK), F.dayofweek(F.to_date("label")), F.lit(1))))


def host_cards(cards: DataFrame, history: DataFrame) -> DataFrame:
    """Users, guilds and daily users; `history` has one row for today (days_ago 0)."""
    today = history.where("days_ago = 0").agg(F.sum("dau").alias("dau_today"))
    return cards.select("user_count", "user_increment", "guild_count", "guild_increment", F.round("recent_dau", 1).alias("recent_dau")).join(today)  # one row each


def model_pie(share: DataFrame) -> DataFrame:
    return share.select(F.concat_ws("/", F.nullif("provider", F.lit("")), "model_id").alias("name"), F.col("token_count").alias("value")).orderBy(F.desc("value"), "name")


def token_lines(trend: DataFrame) -> DataFrame:
    """date, series (prompt, completion), value."""
    return trend.select("date", F.explode(F.create_map(F.lit("prompt"), "prompt_tokens", F.lit("completion"), "completion_tokens")).alias("series", "value")).orderBy("date", "series")


def number_cards(overview: DataFrame) -> DataFrame:
    """Rounded figures of an overview: success in percent, latency in seconds."""
    return overview.select("total_requests", "total_tokens", F.round(F.col("success_rate") * 100, 1).alias("success_percent"), F.round(F.col("avg_latency_ms") / 1000, 2).alias("avg_latency_s"))
