"""The whole dashboard: every figure as a DataFrame, or all of them folded into one row.

Figures of all periods come from one reduction: each fact table is read once, summed by day (or cut to
the newest records that any figure shows) and stored; the figures read those small tables.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import open_ended
from ..sources.tables import shared_folder
from . import ai, dashboard, images

#: Newest AI requests that the ranking of users looks at.
RANKED_REQUESTS = 5000


@dataclass(frozen=True)
class Inputs:
    """What the dashboard reads: fact tables, records and the host's users and channels."""

    commands: DataFrame
    messages: DataFrame
    profiles: DataFrame
    users: DataFrame
    channels: DataFrame
    ai_requests: DataFrame
    ai_daily: DataFrame
    images: DataFrame


def _stored(df: DataFrame, what: str) -> DataFrame:
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reduced(t: Inputs, as_of: int, config: Config) -> Inputs:
    """The inputs as far as figures need them: facts by day, the newest requests, rows of the longest period."""
    longest = max(*dashboard.PERIODS, config.recent_day_count)
    recent = lambda df: df.where(open_ended(F.col("date"), as_of, longest))
    # The newest requests of a shorter period are among the newest of the longest one.
    requests = ai.newest(t.ai_requests.select("id", "timestamp", "date", "userId", "totalTokens"), as_of, longest, RANKED_REQUESTS)
    return Inputs(
        commands=_stored(recent(t.commands).groupBy("date", "userId", "name").agg(F.sum("count").alias("count")), "commands-by-day"),
        messages=_stored(recent(t.messages).groupBy("date", "hour", "type").agg(F.sum("count").alias("count")), "messages-by-day"),
        profiles=t.profiles,
        users=t.users,
        channels=t.channels,
        ai_requests=_stored(requests, "newest-requests"),
        ai_daily=_stored(recent(t.ai_daily), "daily"),
        images=_stored(recent(t.images).select("date", "styleName", "commandName", "numImages", "success", "freeUsed", "purchasedUsed"), "recent-images"),
    )


def period_figures(t: Inputs, as_of: int, days: int) -> dict[str, DataFrame]:
    """The figures of one period."""
    return {
        "command_rate": dashboard.command_rate(t.commands, as_of, days),
        "user_usage_rank": dashboard.user_usage_rank(t.commands, t.profiles, t.users, as_of, days),
        "message_by_hour": dashboard.message_by_hour(t.messages, as_of, days),
        "ai_overview": ai.ai_overview(t.ai_daily, as_of, days),
        "model_share": ai.model_share(t.ai_daily, as_of, days),
        "token_trend": ai.token_trend(t.ai_daily, as_of, days),
        "failure_rate": ai.failure_rate(t.ai_daily, as_of, days),
        "ai_user_rank": ai.ai_user_rank(t.ai_requests, as_of, days),
        "image_overview": images.image_overview(t.images, as_of, days),
        "style_rank": images.style_rank(t.images, as_of, days),
    }


def cards(t: Inputs, as_of: int, config: Config) -> DataFrame:
    """One row: users, guilds, their increments of yesterday, mean DAU, and AI and image totals of the default period."""
    days = config.default_period
    parts = [
        dashboard.user_count(t.users),
        dashboard.user_increment(t.users, as_of),
        dashboard.guild_count(t.channels),
        dashboard.guild_increment(t.channels, as_of),
        dashboard.recent_dau(dashboard.dau_history(t.commands, as_of, config.recent_day_count)),
        ai.ai_overview(t.ai_daily, as_of, days).select("total_requests", "total_tokens", "success_rate"),
        images.image_overview(t.images, as_of, days).select("total_generations", "total_images"),
    ]
    row = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        row = row.join(p.withColumn("_one", F.lit(1)), "_one")  # one row each
    return row.drop("_one")


def figures(t: Inputs, as_of: int, config: Config | None = None) -> dict[str, DataFrame]:
    """All figures by name; those of periods as name_days."""
    config = config or Config()
    t = reduced(t, as_of, config)
    found = {"cards": cards(t, as_of, config), "dau_history": dashboard.dau_history(t.commands, as_of, config.recent_day_count), "message_by_date": dashboard.message_by_date(t.messages, as_of)}
    for days in dashboard.PERIODS:
        found |= {f"{name}_{days}": df for name, df in period_figures(t, as_of, days).items()}
    return found


def _folded(df: DataFrame, name: str) -> DataFrame:
    """All rows of a figure as one array; figures are small: ranks, days, hours, models."""
    return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)).withColumn("_one", F.lit(1))


def payload(t: Inputs, as_of: int, config: Config | None = None) -> DataFrame:
    """One row with every figure as an array of structs; toJSON() gives the document that a page shows."""
    found = figures(t, as_of, config)
    row = None
    for name, df in found.items():
        part = _folded(df, name)
        row = part if row is None else row.join(part, "_one")
    return row.drop("_one")


def stored_payload(tables, t: Inputs, as_of: int, config: Config | None = None) -> DataFrame:
    """The payload, worked out once for a day and a state of the stored tables; later calls read what the first one wrote.

    A commit to the tables makes it anew. Users and channels of the host are as they were at the first call.
    """
    config = config or Config()
    folder, settings = f"{tables.root}/_payload", zlib.crc32(repr(config).encode())
    name = f"{as_of}-{tables.state().version}-{settings}"
    if not tables.exists(f"{folder}/{name}"):
        payload(t, as_of, config).write.mode("overwrite").parquet(f"{folder}/{name}")
        for old in tables._list(folder):
            if old != name and old.endswith(f"-{settings}"):
                tables.remove(f"{folder}/{old}")
    return tables.spark.read.parquet(f"{folder}/{name}")
