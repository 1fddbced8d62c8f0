"""Hourly facts from events, and merges of stored tables by key.

Counts are pre-aggregated by Spark before the shuffle. Merging is additive (counts) or by the latest
row (records and profiles); both work on whole keys and need one shuffle by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import day_number
from ..functions.text import first_name

MESSAGE_KEY = ["date", "hour", "type", "selfId", "platform"]
COMMAND_KEY = ["date", "hour", "name", "selfId", "userId", "channelId", "platform"]


def with_place_in_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn("date", day_number(F.col(ts))).withColumn("hour", F.hour(ts))


def hourly_counts(events: DataFrame, key: list[str]) -> DataFrame:
    """How many events fall on each key."""
    return events.groupBy(*key).agg(F.count("*").alias("count"))


def message_facts(events: DataFrame) -> DataFrame:
    """Events (ts, type, selfId, platform) to hourly message counts."""
    return hourly_counts(with_place_in_time(events), MESSAGE_KEY)


def command_facts(events: DataFrame) -> DataFrame:
    """Events (ts, name, selfId, userId, channelId, platform) to hourly command counts."""
    return hourly_counts(with_place_in_time(events), COMMAND_KEY)


def add_counts(*parts: DataFrame, key: list[str]) -> DataFrame:
    """One row a key with the sum of all parts' counts; missing counts are 0."""
    whole = parts[0].select(*key, "count")
    for p in parts[1:]:
        whole = whole.unionByName(p.select(*key, "count"))
    return whole.groupBy(*key).agg(F.sum(F.coalesce("count", F.lit(0))).alias("count"))


def latest_by_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; `order` should tell all rows of a key apart."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of `new` replace those of `old` with equal keys; of equal ones in `new` the last by `order` stays."""
    both = old.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)))
    rest = order or [c for c in new.columns if c not in key]
    return latest_by_key(both, key, [F.col("_part"), *[F.col(c) for c in rest]]).drop("_part")


def delete_keys(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def user_profiles(events: DataFrame, candidates: list[str]) -> DataFrame:
    """The latest profile of each user: userId 0 and users without a name are skipped."""
    named = events.withColumn("userName", first_name(*[F.col(c) for c in candidates])).where("userId <> 0 and userName is not null")
    rows = named.select("userId", "platform", "platformUserId", "userName", F.col("ts").alias("updatedAt"))
    return latest_by_key(rows, ["userId"], [F.col("updatedAt"), F.col("userName"), F.col("platformUserId"), F.col("platform")])


def offsets_with_legacy(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Offsets of files, from the older table only for names that the current one lacks."""
    old = legacy.select("fileName", "size", "lastOffset", F.lit(0).cast("long").alias("mtimeMs"))
    return current.select("fileName", "size", "lastOffset", "mtimeMs").unionByName(old.join(current.select("fileName"), "fileName", "left_anti"))


def leading_run(files: DataFrame) -> DataFrame:
    """One row with the cursor after a batch of files (key, done): the last file before the first that is not done."""
    first_open = files.agg(F.min(F.when(~F.col("done"), F.col("key"))).alias("open"))
    joined = files.join(F.broadcast(first_open), F.col("open").isNull() | (F.col("key") < F.col("open")))  # one row
    return joined.agg(F.max("key")["name"].alias("cursor"))
