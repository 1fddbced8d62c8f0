"""Groups of what shares a bucket, blocks for comparisons inside large groups, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, passes, stored

#: Bits of the filter of buckets: 8 MB.
BUCKET_BITS = 1 << 26


def _met(bits):
    """Rows with those of their keys that the filter passes, if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            met = passes(bits.value, keys.view(np.uint64))
            before = np.concatenate([[0], np.cumsum(met)])
            bounds = before[offsets - offsets[0]]
            some = np.flatnonzero(np.diff(bounds))
            if len(some):
                ends = np.concatenate([[0], bounds[some + 1]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[met]))], names=["c", "keys"])

    return run


def led_groups(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(leader, c): each class with the leaders of its buckets, itself left out.

    `members` has row, mark and keys: a row's number, a hash of its class, and the buckets it lies in (an
    array of longs). `classes` has c, the row that stands for each class. A bucket is led by its most
    central class, the one with the most company over all its buckets, so two classes that share a bucket
    share its leader, and groups are few. Buckets are counted before they are shuffled, and only those
    that more than one class has go on: a filter of fixed size spares most others, a join the rest.
    """
    each = members.select("mark", F.explode("keys").alias("key"))
    met = each.groupBy("key").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("key")
    met = stored(met, "buckets")
    bits = members.sparkSession.sparkContext.broadcast(bit_filter(met.select(F.col("key").alias("hash")), BUCKET_BITS))
    near = members.select("row", "keys").mapInArrow(_met(bits), "c long, keys array<long>").join(classes.select("c"), "c", "left_semi")
    shared = stored(near.select("c", F.explode("keys").alias("key")).join(met, "key"), "shared")
    company = shared.groupBy("key").agg(F.count("*").alias("members"))
    weight = shared.join(company, "key").groupBy("c").agg(F.sum("members").alias("weight"))
    leaders = shared.join(weight, "c").groupBy("key").agg(F.max(F.struct("weight", "c")).alias("top")).select("key", F.col("top.c").alias("leader"))
    return shared.join(leaders, "key").where("c <> leader").select("leader", "c").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that it reaches.

    Alternating large-star and small-star rounds until nothing changes. Every round joins the edges
    with one row for each node, so a star of any size is only a skewed join, which Spark splits;
    minima are pre-aggregated. The number of rounds grows with the logarithm of the size.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        turned = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = cut(turned.distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def block_pairs(members: DataFrame, group: list[str], member: str, blocks: str) -> DataFrame:
    """Deal each group's members into its number of `blocks` and give each pair of blocks its rows.

    Adds lo, hi (the pair) and block (the row's own). A task then holds two blocks, whatever the
    group's size.
    """
    own = F.pmod(F.xxhash64(member), F.col(blocks)).cast("int")
    dealt = members.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", blocks)


def matrix_labels(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric boolean matrix reaches."""
    n = len(linked)
    labels = np.arange(n)
    linked = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(linked, labels[None, :], n).min(axis=1)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new
