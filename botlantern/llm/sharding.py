"""K-d tree partitioning of documents into shards of near-equal bytes.

The tree splits its boxes at weighted medians along their widest metadata dimension: source,
language, length and id of a document, each as an order-preserving whole number. Width is a box's
extent as a share of the whole table's. A box of several shards is split in proportion, down to one
shard each (or until leaves reach a target size). The law is `bytes`: sizes are near equal.

Medians are exact and distributed: all boxes of a level are narrowed at once by histograms of 4096
bins, pre-aggregated in the tasks, so the driver sees 4096 rows a box at most and never a document.
Rows that tie in the chosen dimension are told apart by a hash of their unit, narrowed alike.

What is placed is a unit: all rows of one text, so copies share a shard. Texts whose copies exceed
a tenth of a shard are split by a hash of their rows' numbers into units of about that size, lest a hot group unbalance
the shards; there can be at most 10 x shards of them, so their list has a proven bound.

Slots count rows inside a shard from 0 in order of (doc_id, text hash), by one range partitioning
and a running sum over partitions; no task holds a shard.

Defined cases: a null text has no bytes and counts as one byte like an empty one. Null metadata
come first in a dimension. Null and repeated ids are carried; each row has its own slot. An empty
table gives no rows. Missing metadata columns are left out; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

DIMENSIONS = ("source", "lang", "n_chars", "doc_id")
BINS = 4096
#: A group of copies larger than this share of a shard is split.
GROUP_SHARE = 10


def _coordinate(docs: DataFrame, name: str) -> Column:
    """A whole number that keeps the order of a column; of strings, the first seven bytes."""
    if isinstance(docs.schema[name].dataType, T.StringType):
        padded = F.rpad(F.hex(F.substring(F.encode(F.coalesce(name, F.lit("")), "UTF-8"), 1, 7)), 14, "0")
        return F.conv(padded, 16, 10).cast("long")
    return F.coalesce(F.col(name).cast("long"), F.lit(-1).cast("long"))


def _units(docs: DataFrame, shards: int) -> tuple[DataFrame, list[str], int]:
    """Rows (doc_id, size, text_crc32, unit, coordinates), the dimensions, and all bytes."""
    names = [d for d in DIMENSIONS if d in docs.columns]
    bare = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
        *[_coordinate(docs, d).alias(f"x_{d}") for d in names],
    )
    rows = cut(bare)  # which fixes the numbers of rows
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1, total // max(1, shards * GROUP_SHARE))
    # Their bytes sum to the total at most: shards x GROUP_SHARE of them.
    hot = rows.groupBy("text_hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")).where((F.col("bytes") > most) & (F.col("copies") > 1))
    hot = hot.select("text_hash", F.ceil(F.col("bytes") / F.lit(most)).alias("parts"))
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), F.col("parts")))
    rows = rows.join(F.broadcast(hot), "text_hash", "left").withColumn("unit", F.xxhash64("text_hash", part)).drop("parts", "text_hash", "row")
    return rows, names, total


def _medians(units: DataFrame, plan: dict[int, tuple[str, float]]) -> dict[int, tuple[int, int]]:
    """For each box of the plan (dimension, share of bytes to the left): the last (coordinate, tie) of the left side.

    Each pass narrows a range of coordinates, then of ties, to one of BINS bins.
    """
    column = F.lit(0).cast("long")
    for box, (dim, _) in plan.items():
        column = F.when(F.col("box") == box, F.col(dim)).otherwise(column)
    units = units.where(F.col("box").isin(list(plan))).select("box", column.alias("x"), "tie", "bytes")
    bounds = {r["box"]: r for r in units.groupBy("box").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("bytes").alias("bytes")).collect()}
    low = {b: r["lo"] for b, r in bounds.items()}
    width = {b: r["hi"] - r["lo"] + 1 for b, r in bounds.items()}
    want = {b: plan[b][1] * r["bytes"] for b, r in bounds.items()}
    found: dict[int, tuple[int, int]] = {}
    at: dict[int, int] = {}
    for value in ("x", "tie"):
        if value == "tie":
            at = dict(low)
            low, width = {b: 0 for b in at}, {b: 1 << 48 for b in at}
        while any(w > 1 for w in width.values()):
            chosen, condition = F.lit(None).cast("long"), F.lit(False)
            for b in low:
                step = max(1, math.ceil(width[b] / BINS))
                mine = (F.col("box") == b) & (F.col(value) >= low[b]) & (F.col(value) < low[b] + width[b])
                if at:
                    mine &= F.col("x") == at[b]
                condition |= mine
                chosen = F.when(F.col("box") == b, F.expr(f"({value} - {low[b]}L) div {step}L")).otherwise(chosen)
            bins: dict[int, list] = {b: [] for b in low}
            for r in units.where(condition).groupBy("box", chosen.alias("bin")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect():
                bins[r["box"]].append((r["bin"], r["bytes"], r["n"]))
            for b, found_bins in bins.items():
                step = max(1, math.ceil(width[b] / BINS))
                left = want[b]
                for bin_, bytes_, n in sorted(found_bins):
                    if left <= bytes_ or bin_ == max(x[0] for x in found_bins):
                        break
                    left -= bytes_
                low[b] += bin_ * step
                width[b] = step
                want[b] = left
                if value == "tie" and n == 1:
                    # One unit: it goes to the nearer side.
                    low[b] = low[b] + step - 1 if 2 * left >= bytes_ else low[b] - 1
                    width[b] = 1
    for b in at:
        found[b] = (at[b], low[b])
    return found


def kd_shards(docs: DataFrame, shards: int) -> DataFrame:
    """Each document's shard: doc_id, size, text_crc32, shard (0 to shards - 1), by the law `bytes`."""
    rows, names, total = _units(docs, shards)
    dims = [f"x_{n}" for n in names]
    units = rows.groupBy("unit").agg(F.sum("size").alias("bytes"), *[F.min(d).alias(d) for d in dims])
    units = cut(units.withColumn("tie", F.shiftrightunsigned(F.xxhash64("unit"), 16)).withColumn("box", F.lit(0)))
    extent = units.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    whole = {d: max(1, (extent[f"hi_{d}"] or 0) - (extent[f"lo_{d}"] or 0)) for d in dims}

    # A box is known by its first shard; leaves[box] is how many shards it holds.
    leaves = {0: shards}
    place = F.lit(0)
    while total and (split := {b: n for b, n in leaves.items() if n > 1}):
        boxed = units.withColumn("box", place.cast("int"))
        spans = boxed.where(F.col("box").isin(list(split))).groupBy("box").agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).collect()
        plan = {r["box"]: (max(dims, key=lambda d, r=r: (r[d] / whole[d], -dims.index(d))), (split[r["box"]] // 2) / split[r["box"]]) for r in spans}
        cuts = _medians(boxed, plan)
        nested = place
        for b, (x, tie) in cuts.items():
            left = split[b] // 2
            dim = F.col(plan[b][0])
            right = (dim > x) | ((dim == x) & (F.col("tie") > tie))
            nested = F.when(F.col("box") == b, F.when(right, b + left).otherwise(b)).otherwise(nested)
            leaves[b], leaves[b + left] = left, split[b] - left
        for b in split:
            if b not in cuts:
                leaves[b] = 1
        units = cut(boxed.withColumn("box", nested.cast("int")))
        place = F.col("box")
    placed = units.select("unit", F.col("box").cast("int").alias("shard"))
    return rows.join(placed, "unit").select("doc_id", "size", "text_crc32", "unit", "shard")


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Adds slot: the row's place in its shard by `order`, from 0 without gaps."""
    ranged = rows.repartitionByRange(shard, *order).sortWithinPartitions(shard, *order)
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    # One row for each partition and each shard in it: partitions + shards at most.
    runs = ranged.groupBy(shard, "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(shard, "part", "first", "before")
    return ranged.join(F.broadcast(runs), [shard, "part"]).withColumn("slot", F.col("row") - F.col("first") + F.col("before")).drop("part", "row", "first", "before")


def shard_digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    rows = with_slots(kd_shards(docs, shards), "shard", ["doc_id", "text_crc32", "unit"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
