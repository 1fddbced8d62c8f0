"""Figures of image generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import first_filled, open_ended, whole
from .ai import newest


def image_overview(images: DataFrame, as_of: int, days: int) -> DataFrame:
    """One row: total_generations, total_images, success_count, free_used, purchased_used."""
    total = lambda c, name: F.coalesce(F.sum(whole(F.col(c))), F.lit(0)).alias(name)
    return images.where(open_ended(F.col("date"), as_of, days)).agg(
        F.count("*").alias("total_generations"),
        total("numImages", "total_images"),
        F.count_if(F.col("success")).alias("success_count"),
        total("freeUsed", "free_used"),
        total("purchasedUsed", "purchased_used"),
    )


def style_rank(images: DataFrame, as_of: int, days: int, top: int = 10) -> DataFrame:
    """style_name (else the command's, else unknown), count, total_images; most images first."""
    style = F.coalesce(first_filled(F.col("styleName"), F.col("commandName")), F.lit("unknown"))
    sums = images.where(open_ended(F.col("date"), as_of, days)).groupBy(style.alias("style_name")).agg(F.count("*").alias("count"), F.sum(whole(F.col("numImages"))).alias("total_images"))
    return sums.orderBy(F.desc("total_images"), "style_name").limit(top)


def recent_images(images: DataFrame, as_of: int, days: int, limit: int = 10_000) -> DataFrame:
    return newest(images, as_of, days, limit)
