"""A content-addressed store of token ids.

Encoding gives each document a stream of ids with an end id. A rolling hash over the last 16 ids
cuts the stream into chunks where its top bits are zero (with a least and a most length), so equal
passages give equal chunks wherever they stand. The store is four Parquet folders under one path:

    chunks     key (BLAKE2b-128 of the ids as little-endian uint32), n, ids (zstd) - once each
    recipes    shard, doc_id, text_key, n_tokens, chunks (digests in order), root - by doc_id
    shards     shard, first position of the shard in the id stream, documents, ids, root
    manifest   one row: format, width, documents, ids, chunks, root

A root is a Merkle root: of a document over its chunks, of a shard over its documents, of the
store over its shards. Reading first makes the shards' roots and sums anew from the recipes and holds
them against those stored and against the manifest; then it joins recipes with chunks, checks every
chunk's digest and every document's root, and puts each document's ids together again; verifying does
the same with checksums in place of the ids. What is missing or altered is an error.

Order and positions: recipes are range-partitioned by (doc_id, text_key); a shard is one range, so
positions need one running sum over the shards (as many rows as partitions) and one inside each.

Defined cases: a null text is an empty one, with only its end id. A null doc_id comes first. Equal
doc_ids follow the order of their texts' hash; equal rows stand one after the other, each with its
own position. Empty tables give an empty store. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove_folder, shared_folder, small_batches, tokenizer_path
from .tokens import encoder

END_ID = 2
SPAN = 16
#: A chunk ends at one of so many places, as a power of two.
MASK_BITS = 10
LEAST, MOST = 128, 8192
_U = np.uint64


def cut_points(streams: list[np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each stream.

    The rolling hash of a place is the sum of hashes of the last SPAN ids, mixed; all streams of a
    batch are hashed at once. Places before LEAST are no ends, so a hash never spans two streams.
    """
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    h = (np.concatenate(streams).astype(np.uint64) + _U(1)) * _U(0xD1342543DE82EF95)
    h ^= h >> _U(29)
    sums = np.cumsum(h, out=h)
    rolled = (sums[SPAN:] - sums[:-SPAN]) * _U(0x9E3779B97F4A7C15)
    marks = np.flatnonzero(rolled >> _U(64 - MASK_BITS) == 0) + SPAN + 1
    near = np.searchsorted(marks, bounds)
    out = []
    for i, start in enumerate(bounds[:-1].tolist()):
        n, ends, last = int(bounds[i + 1]) - start, [], 0
        for at in (marks[near[i] : near[i + 1]] - start).tolist():
            while at - last > MOST:
                last += MOST
                ends.append(last)
            if at - last >= LEAST:
                last = at
                ends.append(at)
        while n - last > MOST:
            last += MOST
            ends.append(last)
        if last < n:
            ends.append(n)
        out.append(ends)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Merkle:
    """A Merkle tree of leaves in order, of which only the roots of whole subtrees are held.

    As if pairs of nodes were hashed level by level, an odd last one moving up.
    """

    def __init__(self):
        self.n, self._whole = 0, []

    def add(self, leaf: bytes) -> None:
        self.n += 1
        # A subtree of 2**k leaves is whole where k bits of the count end in zeros.
        size = self.n
        while size % 2 == 0:
            leaf = digest(b"\1" + self._whole.pop() + leaf)
            size //= 2
        self._whole.append(leaf)

    def root(self) -> bytes:
        """The root of what was added; of nothing if nothing was."""
        if not self._whole:
            return digest(b"\0")
        *left, node = self._whole
        for other in reversed(left):
            node = digest(b"\1" + other + node)
        return node


def merkle_root(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


_STORED = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("n", pa.int64()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("chunks", pa.list_(pa.binary())), ("root", pa.binary())])
_STORED_DDL = "kind string, key binary, n long, ids binary, doc_id long, text_key long, chunks array<binary>, root binary"


def _encode(path: str, kind: str, end_id: int):
    """Rows of both kinds: chunks by their digest, recipes by a key of their own."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press = encoder(path, kind).encode, zstandard.ZstdCompressor(level=1)
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            chunks: dict[bytes, tuple] = {}
            recipes = []
            raws = [ids + end for ids in encode(texts)]
            views = [np.frombuffer(raw, dtype="<u4") for raw in raws]
            for doc_id, text, raw, view, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), raws, views, cut_points(views) if views else [], strict=True):
                # Ids of small vocabularies are stored in half the width; n tells them apart.
                width = 2 if view.max() < 1 << 16 else 4
                stored = view.astype("<u2").tobytes() if width == 2 else raw
                at, own = 0, []
                for to in ends:
                    own.append(digest(raw[4 * at : 4 * to]))
                    if own[-1] not in chunks:
                        chunks[own[-1]] = ("chunk", own[-1], to - at, press.compress(stored[width * at : width * to]), None, None, None, None)
                    at = to
                recipes.append(("recipe", b"%d:%d" % (part, row), len(view), None, doc_id, text, own, merkle_root(own)))
                row += 1
            if rows := [*chunks.values(), *recipes]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STORED, strict=True)], schema=_STORED)

    return run


def _roots(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The Merkle root and sums of each shard, whose rows a task reads in order."""
    trees: dict[int, Merkle] = {}
    ids: dict[int, int] = {}
    for g in groups:
        for shard, n, root in zip(g["shard"], g["n_tokens"], g["root"], strict=True):
            trees.setdefault(shard, Merkle()).add(root)
            ids[shard] = ids.get(shard, 0) + n
    yield pd.DataFrame({"shard": list(trees), "documents": [t.n for t in trees.values()], "ids": list(ids.values()), "root": [t.root() for t in trees.values()]})


def write_store(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte_level", end_id: int = END_ID) -> None:
    """Encode `docs` (doc_id, text) and write the store under `path`."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    # One pass over the texts makes chunks and recipes; equal chunks meet by their digest, after
    # each task has dropped its own repeats, and the payload is shuffled once.
    rows = texts.mapInArrow(_encode(tokenizer, kind, end_id), _STORED_DDL)
    unique = rows.groupBy("kind", "key").agg(*[F.first(c).alias(c) for c in ("n", "ids", "doc_id", "text_key", "chunks", "root")])
    made = f"{path}/made"
    unique.write.partitionBy("kind").option("compression", "none").parquet(made)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    empty = not fs.exists(hadoop(f"{made}/kind=recipe"))
    if empty:
        spark.createDataFrame([], "key binary, n long, ids binary").write.parquet(f"{path}/chunks")
        recipes = spark.createDataFrame([], "doc_id long, text_key long, n long, chunks array<binary>, root binary")
    else:
        fs.rename(hadoop(f"{made}/kind=chunk"), hadoop(f"{path}/chunks"))
        recipes = spark.read.parquet(f"{made}/kind=recipe")
    recipes = recipes.select("doc_id", "text_key", F.col("n").alias("n_tokens"), "chunks", "root")
    ranged = recipes.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    ranged.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("row"), "*").write.option("compression", "zstd").parquet(f"{path}/recipes")
    remove_folder(spark, made)

    shards = _shards(spark, path)
    # As many rows as partitions.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    shards.write.parquet(f"{path}/shards")
    rows = _shard_rows(spark.read.parquet(f"{path}/shards"))
    n = spark.read.parquet(f"{path}/chunks").count()
    manifest = [("token-store-1", 4, sum(r[1] for r in rows), sum(r[2] for r in rows), n, bytearray(merkle_root([bytes(r[3]) for r in rows])))]
    spark.createDataFrame(manifest, "format string, width int, documents long, ids long, chunks long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, documents, ids and root of each shard, from the recipes."""
    kept = spark.read.parquet(f"{path}/recipes").select("shard", "row", "n_tokens", "root")
    return kept.repartition("shard").sortWithinPartitions("shard", "row").mapInPandas(_roots, "shard int, documents long, ids long, root binary")


def _shard_rows(shards: DataFrame) -> list[tuple[int, int, int, bytes]]:
    """As many rows as partitions."""
    return sorted((r["shard"], r["documents"], r["ids"], bytes(r["root"])) for r in shards.select("shard", "documents", "ids", "root").collect())


def check_manifest(spark: SparkSession, path: str) -> None:
    """An error unless recipes, shards and manifest agree."""
    made, manifest = _shard_rows(_shards(spark, path)), spark.read.parquet(f"{path}/manifest").first()
    same = made == _shard_rows(spark.read.parquet(f"{path}/shards")) and merkle_root([r[3] for r in made]) == bytes(manifest["root"])
    if not same or (sum(r[1] for r in made), sum(r[2] for r in made)) != (manifest["documents"], manifest["ids"]):
        raise ValueError("recipes, shards and manifest do not agree")


def _unpacked(n: int, ids: bytes | None, key: bytes, unpress: zstandard.ZstdDecompressor) -> bytes:
    if ids is None:
        raise ValueError("a chunk is missing")
    data = unpress.decompress(ids)
    raw = data if len(data) == 4 * n else np.frombuffer(data, dtype="<u2").astype("<u4").tobytes()
    if digest(raw) != bytes(key):
        raise ValueError("a chunk does not match its digest")
    return raw


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with each document's start: one running sum over shards, one inside each."""
    recipes = spark.read.parquet(f"{path}/recipes").select("shard", "row", "doc_id", "n_tokens", "root")
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("shard_start"))
    before = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)) + F.col("shard_start")
    return recipes.join(shards, "shard").select("row", "doc_id", start.alias("start"), "n_tokens", "root")


def _used(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.parquet(f"{path}/recipes")
    return recipes.select("row", F.posexplode("chunks").alias("pos", "key"))


def _assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document's ids from its chunks; a wrong chunk or root is an error."""
    unpress = zstandard.ZstdDecompressor()
    for g in batches:
        whole = []
        for root, parts in zip(g["root"], g["parts"], strict=True):
            parts = sorted(parts, key=lambda p: p["pos"])
            whole.append(b"".join(_unpacked(p["n"], p["ids"], p["key"], unpress) for p in parts))
            if merkle_root([bytes(p["key"]) for p in parts]) != bytes(root):
                raise ValueError("a document does not match its root")
        yield pd.DataFrame({"doc_id": g["doc_id"], "start": g["start"], "n_tokens": g["n_tokens"], "ids": whole})


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store: doc_id, start, n_tokens, ids (little-endian uint32), verified."""
    small_batches(spark)
    check_manifest(spark, path)
    used = _used(spark, path).join(spark.read.parquet(f"{path}/chunks"), "key", "left")
    parts = used.groupBy("row").agg(F.collect_list(F.struct("pos", "n", "key", "ids")).alias("parts"))
    # Doc ids may be null, which pandas would turn into floats.
    rows = _placed(spark, path).join(parts, "row").select(F.col("doc_id").cast("string").alias("doc_id"), "start", "n_tokens", "root", "parts")
    whole = rows.mapInPandas(_assemble, "doc_id string, start long, n_tokens long, ids binary")
    return whole.withColumn("doc_id", F.col("doc_id").cast("long"))


# --- checksums of documents from those of their chunks --------------------------------------
# CRC-32 is linear over GF(2): appending n bytes multiplies the earlier sum by x**(8 n) modulo the
# polynomial. Fixed value: the reflected CRC-32 polynomial.
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    product, bit = 0, 1 << 31
    while bit:
        if a & bit:
            product ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
        bit >>= 1
    return product


def _shift(n_bytes: int, known: dict[int, int]) -> int:
    """x**(8 n) modulo the polynomial, in reflected bits."""
    if n_bytes not in known:
        power, square, n = 1 << 31, 1 << 30, 8 * n_bytes
        while n:
            if n & 1:
                power = _times(square, power)
            square = _times(square, square)
            n >>= 1
        if len(known) > 10_000:
            known.clear()
        known[n_bytes] = power
    return known[n_bytes]


def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        keys, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        sums = [zlib.crc32(_unpacked(n, ids, key, unpress)) for key, n, ids in zip(keys, ns, batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["key", "n", "crc"])


def _document_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, int] = {}
    for batch in batches:
        parts = batch.column(4)
        bounds = parts.offsets.to_pylist()
        pos, n, keys, crcs = (f.to_pylist() for f in parts.values.flatten())
        sums = []
        for lo, hi, root in zip(bounds, bounds[1:], batch.column(3).to_pylist(), strict=False):
            order = sorted(range(lo, hi), key=pos.__getitem__)
            crc = 0
            if any(crcs[i] is None for i in order):
                raise ValueError("a chunk is missing")
            for i in order:
                crc = (_times(_shift(4 * n[i], known), crc) if crc else 0) ^ crcs[i]
            if merkle_root([keys[i] for i in order]) != root:
                raise ValueError("a document does not match its root")
            sums.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files and verified.

    Every chunk is read, unpacked and checked where it lies; only its sums travel to the recipes
    that use it, so the ids themselves are not shuffled.
    """
    small_batches(spark)
    check_manifest(spark, path)
    sums = spark.read.parquet(f"{path}/chunks").select("key", "n", "ids").mapInArrow(_chunk_sums, "key binary, n long, crc long")
    parts = _used(spark, path).join(sums, "key", "left").groupBy("row").agg(F.collect_list(F.struct("pos", "n", "key", "crc")).alias("parts"))
    rows = _placed(spark, path).join(parts, "row").select("doc_id", "start", "n_tokens", "root", "parts")
    return rows.mapInArrow(_document_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame) -> DataFrame:
    """Write all documents to a store in the shared folder, read it back, and give the contract's columns."""
    spark = docs.sparkSession
    path = shared_folder(spark, "token-store")
    write_store(docs, path, tokenizer_path("byte_bpe_50k.json"))
    return verify_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
