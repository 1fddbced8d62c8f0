"""Benchmark decontamination by a prefix-filtered set join with exact containment of item windows.

A window is 13 consecutive words of an item, or the whole of a shorter one. A window occurs in a
document only if all its shingles (5 words, or all of a shorter window) do, so with full overlap
required its necessary prefix is one token: its rarest shingle over all documents. The steps:

1. count how often each benchmark shingle stands in the documents (pre-aggregated in the tasks);
   windows with a shingle that stands nowhere are gone;
2. order each window's shingles by rarity and keep the rarest with its place in the window;
3. find these prefix tokens in the documents, with the words around them as far as a window with
   such a token reaches (a token of fewer than five words is its window);
4. join on the token, apply the length bound (the document has as many words) and the positional
   bound (the window, laid at its place, lies inside it), and compare the words themselves.

What is broadcast is a bit filter of fixed size (512 KB) over shingle hashes: it only spares rows,
the join decides, so a benchmark of any size stays right. Both joins are left to Spark, which
checks sizes before it broadcasts and splits skewed keys.

Defined cases: a null text has no words; a document without words is clean. A null item_id marks
words as hit but is neither counted nor listed. Repeated items and repeated documents give the
same result for each row; documents are told apart by id and text together, so null or repeated
ids do no harm. An empty benchmark leaves all documents clean. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, Words, bit_filter, byte_slices, cut, passes, pieces, shingle_hashes, small_batches, stored

WINDOW = 13
SHINGLE = 5

def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _item_windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = byte_slices(batch.column(1))
            for lo, run_ in pieces(texts):
                words = Words(run_, ALNUM)
                for i in range(len(run_)):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    if a == b:
                        continue
                    size = min(window, b - a)
                    for s in range(a, b - size + 1):
                        hashes = _signed(shingle_hashes(words.hashes[s : s + size], shingle))
                        out.append((batch.column(0)[lo + i].as_py(), words.text(s, s + size).decode(), size, hashes.tolist()))
            if out:
                item, text, size, hashes = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(text, pa.string()), pa.array(size, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], names=["item_id", "window", "size", "hashes"])

    return run


def _places(words: Words, bits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of the shingles of `size` words that pass the filter, and their hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hashes = shingle_hashes(words.hashes, size)
    at = np.flatnonzero(passes(bits, hashes))
    ends = np.repeat(words.first[1:], words.counts())
    at = at[at + size <= ends[at]]
    return at, hashes[at]


def _count_shingles(bits, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, run_ in pieces(byte_slices(batch.column(0))):
                words = Words(run_, ALNUM)
                found = np.concatenate([_places(words, bits.value, k)[1] for k in sizes])
                if len(found):
                    h, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return run


_CANDIDATE = pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("lead", pa.int32()), ("around", pa.string())])


def _find_prefixes(bits, sizes: list[int], window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = byte_slices(batch.column(1))
            for lo, run_ in pieces(texts):
                words = Words(run_, ALNUM)
                found: list[list[dict]] = [[] for _ in run_]
                for k in sizes:
                    at, hashes = _places(words, bits.value, k)
                    reach = window if k == shingle else k
                    docs = np.searchsorted(words.first, at, side="right") - 1
                    for w, h, d in zip(at.tolist(), _signed(hashes).tolist(), docs.tolist(), strict=True):
                        a, b = int(words.first[d]), int(words.first[d + 1])
                        s = max(a, w - reach + k)
                        found[d].append({"hash": h, "pos": w - a, "lead": w - s, "around": words.text(s, min(b, w + reach)).decode()})
                keys = [hashlib.blake2b(repr(i).encode() + b"\0" + t, digest_size=16).digest() for i, t in zip(ids[lo : lo + len(run_)], run_, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(ids[lo : lo + len(run_)], pa.int64()), batch.column(2).slice(lo, len(run_)), pa.array(words.counts().astype(np.int64)), pa.array(found, pa.list_(_CANDIDATE))],
                    names=["key", "doc_id", "text_hash", "n_words", "candidates"],
                )

    return run


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with candidates, occurrences (key, start, size, window), and owners (window, item_id)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = cut(items.mapInArrow(_item_windows(window, shingle), "item_id long, window string, size int, hashes array<long>"))
    owners = windows.select("window", "item_id").distinct()
    tokens = windows.select("window", "size", "hashes").distinct().select("window", "size", F.posexplode("hashes").alias("offset", "hash"))
    sizes = sorted(min(shingle, r[0]) for r in windows.select("size").distinct().collect())  # at most `window` rows
    sizes = list(dict.fromkeys(sizes))

    bits = spark.sparkContext.broadcast(bit_filter(tokens.select("hash")))
    counts = texts.select("text").mapInArrow(_count_shingles(bits, sizes), "hash long, n long") if sizes else spark.createDataFrame([], "hash long, n long")
    counts = counts.groupBy("hash").agg(F.sum("n").alias("n"))
    ranked = tokens.join(counts, "hash", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "offset")).alias("rarest"))
    prefixes = cut(ranked.where("rarest.n > 0").select("window", "size", "rarest.hash", "rarest.offset"))

    bits = spark.sparkContext.broadcast(bit_filter(prefixes.select("hash")))
    found = stored(texts.mapInArrow(_find_prefixes(bits, sizes, window, shingle), "key binary, doc_id long, text_hash long, n_words long, candidates array<struct<hash:long,pos:int,lead:int,around:string>>"), "decontam")
    places = found.where(F.size("candidates") > 0).select("key", "n_words", F.inline("candidates"))
    fits = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("size") <= F.col("n_words")) & (F.col("lead") >= F.col("offset"))
    laid = F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("offset") + 1, F.col("size")), " ")
    met = places.join(prefixes, "hash").where(fits).where(laid == F.col("window"))
    occurrences = met.select("key", (F.col("pos") - F.col("offset")).alias("start"), "size", "window").distinct()
    return found, occurrences, owners


def benchmark_occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Each place where a benchmark window stands: doc_id, start (word), size (words), window (its text)."""
    found, occurrences, _ = _scan(docs, benchmark, window, shingle)
    return found.select("key", "doc_id").distinct().join(occurrences, "key").drop("key")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_words, n_hit, items (ids as sorted strings), contaminated."""
    found, occurrences, owners = _scan(docs, benchmark, window, shingle)
    occurrences = cut(occurrences)

    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = occurrences.select("key", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hits = spans.select("key", covered.alias("covered")).groupBy("key").agg(F.sum("covered").cast("long").alias("n_hit"))
    items = occurrences.select("key", "window").distinct().join(owners, "window").where("item_id is not null").select("key", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))

    judged = found.where(F.size("candidates") > 0).select("key", "doc_id", "text_hash", "n_words").join(hits, "key", "left").join(items, "key", "left")
    clean = found.where(F.size("candidates") == 0).select("doc_id", "text_hash", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    rows = judged.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).unionByName(clean)
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns: the items as their number and a SHA-256 of the joined ids."""
    rows = contamination(docs, benchmark)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bs
), sizes AS (
  SELECT DISTINCT n FROM bw
), ds AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n
), hit AS (
  SELECT ds.doc_id, ds.p, ds.n, bw.item_id FROM (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM ds) ds JOIN bw ON bw.g = ds.g AND bw.n = ds.n
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit, coalesce(items.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items.joined, '')) AS items_sha256,
  coalesce(words.n_hit, 0) > 0 AND 20 * coalesce(words.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
