"""The dashboard's message, command, user and guild figures.

`as_of` is the day number that counts as today. Every limit has a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import closed_past, first_filled, open_ended
from ..functions.time import yesterday

PERIODS = (7, 30, 90)


def spine(spark: SparkSession, first: int, last: int, name: str) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def command_rate(commands: DataFrame, as_of: int, days: int) -> DataFrame:
    """name, daily_rate: calls a day in the closed past."""
    recent = commands.where(closed_past(F.col("date"), as_of, days))
    return recent.groupBy("name").agg((F.sum("count") / F.lit(float(days))).alias("daily_rate"))


def dau_history(commands: DataFrame, as_of: int, days: int) -> DataFrame:
    """days_ago (0 to days), dau: distinct users of each day, without user 0; empty days are 0."""
    recent = commands.where(open_ended(F.col("date"), as_of, days) & (F.col("date") <= as_of) & (F.col("userId") > 0))
    daily = recent.groupBy("date").agg(F.countDistinct("userId").alias("dau")).select((F.lit(as_of) - F.col("date")).alias("days_ago"), "dau")
    return spine(commands.sparkSession, 0, days, "days_ago").join(daily, "days_ago", "left").select("days_ago", F.coalesce("dau", F.lit(0)).cast("long").alias("dau"))


def recent_dau(history: DataFrame) -> DataFrame:
    """The mean of all past days, today left out, empty days counted."""
    return history.where("days_ago >= 1").agg(F.coalesce(F.avg("dau"), F.lit(0.0)).alias("recent_dau"))


def user_usage_rank(commands: DataFrame, profiles: DataFrame, users: DataFrame, as_of: int, days: int, top: int = 10) -> DataFrame:
    """rank, user_id, user_name, count, daily_average, top_command of the most active users.

    Counts by user and command are made once; users' totals and first commands come from them.
    Names are joined to the few ranked users only: the profile's, else the host's.
    """
    recent = commands.where(closed_past(F.col("date"), as_of, days) & (F.col("userId") > 0))
    pairs = recent.groupBy("userId", "name").agg(F.sum("count").alias("n"))
    # The most used command; of equal ones the first by name.
    best = F.min(F.struct((-F.col("n")).alias("order"), F.col("name").alias("name")))["name"]
    ranked = pairs.groupBy("userId").agg(F.sum("n").alias("count"), best.alias("top_command")).orderBy(F.desc("count"), "userId").limit(top)
    host = users.select(F.col("id").alias("userId"), F.col("name").alias("hostName"))
    named = ranked.join(profiles.select("userId", "userName"), "userId", "left").join(host, "userId", "left")
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("count"), "userId"))  # of `top` rows
    return named.select(
        place.alias("rank"),
        F.col("userId").alias("user_id"),
        first_filled(F.col("userName"), F.col("hostName")).alias("user_name"),
        "count",
        (F.col("count") / F.lit(float(days))).alias("daily_average"),
        "top_command",
    )


def message_by_date(messages: DataFrame, as_of: int, days: int = 90, dense: bool = True) -> DataFrame:
    """days_ago, send, receive. Dense: 1 to days; else 0 to the earliest day that has messages."""
    recent = messages.where(closed_past(F.col("date"), as_of, days))
    daily = recent.groupBy((F.lit(as_of) - F.col("date")).alias("days_ago")).agg(*[F.sum(F.when(F.col("type") == t, F.col("count")).otherwise(0)).alias(t) for t in ("send", "receive")])
    days_ = spine(messages.sparkSession, 1 if dense else 0, days, "days_ago")
    if not dense:
        last = daily.agg(F.max("days_ago").alias("last"))
        days_ = days_.join(F.broadcast(last), F.col("days_ago") <= F.col("last")).select("days_ago")  # one row
    return days_.join(daily, "days_ago", "left").select("days_ago", *[F.coalesce(t, F.lit(0)).cast("long").alias(t) for t in ("send", "receive")])


def message_by_hour(messages: DataFrame, as_of: int, days: int) -> DataFrame:
    """hour (0 to 23), send, receive: messages a day."""
    recent = messages.where(closed_past(F.col("date"), as_of, days))
    hourly = recent.groupBy("hour").agg(*[F.sum(F.when(F.col("type") == t, F.col("count")).otherwise(0)).alias(t) for t in ("send", "receive")])
    return spine(messages.sparkSession, 0, 23, "hour").join(hourly, "hour", "left").select("hour", *[(F.coalesce(t, F.lit(0)) / F.lit(float(days))).alias(t) for t in ("send", "receive")])


def user_count(users: DataFrame) -> DataFrame:
    return users.agg(F.countDistinct("id").alias("user_count"))


def user_increment(users: DataFrame, as_of: int) -> DataFrame:
    """Users made yesterday."""
    return users.where(yesterday(F.col("createdAt"), as_of)).agg(F.countDistinct("id").alias("user_increment"))


def guild_count(channels: DataFrame) -> DataFrame:
    """Channels that are their own guild."""
    return channels.where("id = guildId").agg(F.count("*").alias("guild_count"))


def guild_increment(channels: DataFrame, as_of: int) -> DataFrame:
    return channels.where("id = guildId").where(yesterday(F.col("createdAt"), as_of)).agg(F.count("*").alias("guild_increment"))


def _by_period(rows: DataFrame, as_of: int, periods: tuple[int, ...]) -> DataFrame:
    """Each row once for every period that holds it: one scan for all, at most len(periods) rows for one."""
    wide = rows.where(closed_past(F.col("date"), as_of, max(periods)))
    held = F.filter(F.array(*[F.lit(p) for p in periods]), lambda p: F.col("date") >= F.lit(as_of) - p)
    return wide.withColumn("period", F.explode(held))


def command_rate_by_period(commands: DataFrame, as_of: int, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """period, name, daily_rate, from one scan."""
    # Summed by day first: the rows that are repeated for the periods are few.
    daily = commands.where(closed_past(F.col("date"), as_of, max(periods))).groupBy("date", "name").agg(F.sum("count").alias("count"))
    return _by_period(daily, as_of, periods).groupBy("period", "name").agg((F.sum("count") / F.col("period").cast("double")).alias("daily_rate"))


def message_by_hour_by_period(messages: DataFrame, as_of: int, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """period, hour, send, receive, from one scan."""
    daily = messages.where(closed_past(F.col("date"), as_of, max(periods))).groupBy("date", "hour", "type").agg(F.sum("count").alias("count"))
    sums = _by_period(daily, as_of, periods).groupBy("period", "hour").agg(*[F.sum(F.when(F.col("type") == t, F.col("count")).otherwise(0)).alias(t) for t in ("send", "receive")])
    spark = messages.sparkSession
    slots = spine(spark, 0, 23, "hour").withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))
    return slots.join(sums, ["period", "hour"], "left").select("period", "hour", *[(F.coalesce(t, F.lit(0)) / F.col("period").cast("double")).alias(t) for t in ("send", "receive")])
