"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on Gaussian directions; a projection plus a random shift, cut into
bins of width `WIDTH`, is one hash, and `HASHES` of them with the label and the table's number are a
table's key. For unit vectors a cosine of 0.98 or more is a distance of 0.2 or less, at which one
hash agrees with probability 0.84 or more and a pair is missed by all `TABLES` tables with
probability (1 - 0.84**10)**48, about 7e-5 for the farthest pairs and far less for nearer ones.

Equal vectors of one label are one class first and count as often as they occur. Each bucket is led
by its most central class, and what shares a bucket is in its leader's group: dense sets of vectors,
which share most of their buckets, make one group. A group is dealt in blocks of bounded size; a task
computes the cosines of two blocks in double precision. A pair counts only in the first group that it
shares, so link counts need no list of pairs: a task gives each member its links and the edges of a
spanning forest. All members of a group are compared; buckets and groups are not capped.

Defined cases: a null label, a null or empty vector, one with null or non-finite components, and a
zero vector link with nothing. Vectors of different length do not link. Null vec_ids are linked like
others, never name a component unless all its ids are null, and are not kept. Rows that repeat a
vec_id are vectors of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, runs, small_batches, stored
from .components import block_pairs, connected_components, led_groups, matrix_labels

TABLES = 48
HASHES = 10
WIDTH = 1.0
BLOCK_MEMBERS = 512
SEED = 20_240_131
_U = np.uint64


def _directions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, TABLES * HASHES)), rng.uniform(0, WIDTH, TABLES * HASHES)


def table_keys(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The keys, vectors x tables, of normalised vectors of one length."""
    directions, shifts = _directions(vectors.shape[1])
    bins = np.floor((vectors @ directions + shifts) / WIDTH).astype(np.int64).view(np.uint64)
    bins = bins.reshape(len(vectors), TABLES, HASHES)
    keys = mix(labels.astype(np.int64).view(np.uint64)[:, None] * _U(0x9E3779B97F4A7C15) + np.arange(1, TABLES + 1, dtype=np.uint64)[None, :])
    for h in range(HASHES):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + bins[:, :, h])
    return keys.view(np.int64)


def _units(matrix: np.ndarray) -> np.ndarray:
    # Very large or small components would over- or underflow when squared.
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _pack(vector: np.ndarray) -> bytes:
    """A vector's bytes, in single precision if that is exact."""
    with np.errstate(over="ignore"):
        half = vector.astype(np.float32)
    return b"f" + half.tobytes() if (half == vector).all() else b"d" + vector.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.float32 if packed[:1] == b"f" else np.float64, offset=1).astype(np.float64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        labels, lists = batch.column(2).to_pylist(), batch.column(1)
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        starts, flat = np.cumsum(sizes) - sizes, lists.flatten().to_numpy(zero_copy_only=False)
        labelled = np.array([x is not None for x in labels])
        digests: list[bytes | None] = [None] * n
        packed: list[bytes | None] = [None] * n
        marks: list[int | None] = [None] * n
        keys: list[np.ndarray | None] = [None] * n
        for length in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero((sizes == length) & labelled)
            matrix = flat[starts[rows][:, None] + np.arange(length)[None, :]].reshape(len(rows), length)
            able = np.isfinite(matrix).all(axis=1) & matrix.any(axis=1)
            rows, matrix = rows[able], matrix[able]
            if not len(rows):
                continue
            for i, vector, key in zip(rows.tolist(), matrix, table_keys(_units(matrix), np.array([labels[i] for i in rows])), strict=True):
                digests[i] = hashlib.blake2b(b"%d " % labels[i] + vector.tobytes(), digest_size=16).digest()
                marks[i] = int.from_bytes(digests[i][:8], "little", signed=True)
                packed[i], keys[i] = _pack(vector), key
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(marks, pa.int64()), pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["vec_id", "vector_key", "mark", "vector", "keys"])


def _compare_blocks(least: float):
    """Each member's links that are first met in this group, and edges of a spanning forest.

    Rows are (leader, lo, hi, block, c, copies, earlier, vector), with the leaders of a member's earlier groups.
    """

    def rows_of(batch: pa.RecordBatch) -> list[tuple]:
        return list(zip(*(batch.column(i).to_pylist() for i in range(3, 8)), strict=True))

    def compared(rows: list[tuple], cross: bool) -> pa.RecordBatch | None:
        block, ids, copies, earlier, packed = zip(*rows, strict=True)
        block, ids, copies = np.array(block), np.array(ids), np.array(copies)
        vectors = [_unpack(p) for p in packed]
        lengths = np.array([len(v) for v in vectors])
        linked = np.zeros((len(ids), len(ids)), dtype=bool)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            units = _units(np.array([vectors[i] for i in own]))
            linked[np.ix_(own, own)] = units @ units.T >= least
        np.fill_diagonal(linked, False)
        if cross:
            linked &= block[:, None] != block[None, :]
        owner = np.repeat(np.arange(len(ids)), [len(e) for e in earlier])
        if len(owner):
            _, codes = np.unique(np.concatenate([np.array(e, dtype=np.int64) for e in earlier]), return_inverse=True)
            for c in range(0, int(codes.max()) + 1, 4096):
                use = (codes >= c) & (codes < c + 4096)
                part = np.zeros((len(ids), min(4096, int(codes.max()) + 1 - c)), dtype=np.float32)
                part[owner[use], codes[use] - c] = 1
                linked &= part @ part.T == 0
        links = linked @ copies
        labels = matrix_labels(linked)
        found = np.flatnonzero((links > 0) | (labels != np.arange(len(ids))))
        if len(found):
            return pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(links[found].astype(np.int64)), pa.array(ids[labels[found]])], names=["c", "links", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), rows in runs(batches, 3, rows_of):
            if (made := compared(rows, lo != hi)) is not None:
                yield made

    return run


def near_duplicate_vectors(rows: DataFrame, least: float = 0.98) -> DataFrame:
    """Each vector with its links and component: vec_id, n_links, component_id, kept.

    `rows` has vec_id, embedding and label; pairs of equal label with a cosine of `least` or more link.
    """
    small_batches(rows.sparkSession)
    bare = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    made = bare.mapInArrow(_features, "vec_id long, vector_key binary, mark long, vector binary, keys array<long>")
    features = stored(made.withColumn("row", F.monotonically_increasing_id()), "vectors")

    able = features.where("vector_key is not null")
    classes = stored(able.groupBy("vector_key").agg(F.min("row").alias("c"), F.min("vec_id").alias("smallest"), F.count("*").alias("copies")), "vector-classes")
    spokes = led_groups(able.select("row", "mark", "keys"), classes)
    spokes = stored(spokes.unionByName(spokes.select("leader", F.col("leader").alias("c")).distinct()), "vector-groups")
    # A vector lies in as many groups as it has buckets, at most, and its own.
    groups = spokes.groupBy("c").agg(F.collect_list("leader").alias("leaders")).join(classes.select("c", "copies"), "c")
    vectors = groups.join(able.select(F.col("row").alias("c"), "vector"), "c")
    blocks = spokes.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).alias("blocks"))
    dealt = block_pairs(spokes.join(blocks, "leader"), ["leader"], "c", "blocks").join(vectors, "c")
    dealt = dealt.select("leader", "lo", "hi", "block", "c", "copies", F.expr("filter(leaders, x -> x < leader)").alias("earlier"), "vector")
    found = dealt.repartition("leader", "lo", "hi").sortWithinPartitions("leader", "lo", "hi").mapInArrow(_compare_blocks(least), "c long, links long, to long")
    found = stored(found, "vector-links")

    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("c <> to").select(F.col("c").alias("a"), F.col("to").alias("b")))
    rooted = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").join(links, "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    per_class = rooted.join(named, "root").select("vector_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")

    joined = able.select("vec_id", "vector_key").join(per_class, "vector_key").drop("vector_key")
    alone = features.where("vector_key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), able AS MATERIALIZED (
  SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM able x JOIN able y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a) n USING (vec_id)
JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) r USING (vec_id)
"""
