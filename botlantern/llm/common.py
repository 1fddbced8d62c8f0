"""Shared pieces of the training-data operators: tables, lineage cuts, byte-level word hashing."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Rows that Arrow hands to Python at once; long texts make larger batches needless memory.
BATCH_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the text that one Arrow batch holds; a user's smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir.

    Where it is unset, a local session (as in tests) gets a folder of its own; on a cluster that is an
    error, since executors would each write to their own disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="botlantern-"))
    return sc.getCheckpointDir()


class _Named(threading.local):
    """Folders that a thread has named in the shared one: what runs beside it has its own."""

    def __init__(self):
        self.paths: list[str] = []


_NAMED = _Named()


def shared_folder(spark: SparkSession, what: str) -> str:
    path = f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _NAMED.paths.append(path)
    return path


def named() -> int:
    """How many folders this thread has named so far."""
    return len(_NAMED.paths)


def clean(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Remove the tables that this thread has written to the shared folder, but `since` earlier ones and `keep`.

    Results read from them end.
    """
    gone = [path for path in _NAMED.paths[since:] if path != keep]
    _NAMED.paths[since:] = [path for path in _NAMED.paths[since:] if path == keep]
    for path in gone:
        remove_folder(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder as Parquet and read back: later readers prune columns."""
    path = shared_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# --- a bit filter of fixed size -----------------------------------------------------------

#: Bits of a filter; a power of two. 512 KB.
FILTER_BITS = 1 << 22


#: Bits of the largest filter, 32 MB.
MOST_BITS = 1 << 28


def filter_bits(n: int) -> int:
    """Bits for n hashes: ten for each, so that one hash in ten that is not there passes, within bounds."""
    return min(MOST_BITS, max(FILTER_BITS, 1 << (10 * n).bit_length()))


def bit_filter(hashes: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """A filter of a column `hash` of longs, to be broadcast: `size` bits, whatever the rows.

    It passes every hash of the column and some others; at most size / 64 rows reach the driver.
    """
    place = F.col("hash").bitwiseAND(size - 1)
    words = hashes.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[found.column("word").to_numpy()] = found.column("bit").to_numpy()
    return bits


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes & np.uint64(64 * len(bits) - 1)).astype(np.int64)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def passing(hashes: Column, bits) -> Column:
    """Whether the filter, a broadcast one, passes a column of hashes."""

    @F.pandas_udf(BooleanType())
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, h.to_numpy(dtype=np.int64).view(np.uint64)))

    return test(hashes)


# --- words as bytes -----------------------------------------------------------------------

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}
#: Bytes of text that are looked at together; a longer text is a piece of its own.
PIECE = 1 << 20

#: Only A-Z change; the bytes of other letters stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Word bytes of the class [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[0x20] = NOT_SPACE[0x09:0x0E] = False


def _powers(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _POW.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        have[0] = 1
        _POW[key] = np.cumprod(have, out=have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> np.ndarray:
    return _powers(_BASE, n, "base")


def inverse_powers(n: int) -> np.ndarray:
    return _powers(_BASE_INV, n, "inv")


class Words:
    """Words of some texts: byte bounds, 64-bit hashes, and the first word of each text.

    The texts lie one after another with a space between, so that no word spans two of them.
    """

    def __init__(self, texts: list[bytes], kind: np.ndarray):
        self.buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
        flags = np.zeros(len(self.buf) + 1, dtype=np.int8)
        flags[1:] = kind[self.buf]
        step = np.diff(flags)
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        self.offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offsets[1:])
        #: self.first[i]:self.first[i + 1] are the words of text i.
        self.first = np.searchsorted(self.starts, self.offsets)

        self.hashes = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(self.starts):
            # As many words as PIECE bytes hold, so that a long text takes no more room than a short one.
            to = int(np.searchsorted(self.ends, self.starts[at] + PIECE, side="right"))
            if to > at:
                self.hashes[at:to] = self._sums(self.starts[at:to], self.ends[at:to])
            else:
                to = at + 1
                self.hashes[at] = self._long_sum(int(self.starts[at]), int(self.ends[at]))
            at = to
        self.hashes = mix(self.hashes + (self.ends - self.starts).astype(np.uint64))

    def _sums(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The sum of (byte + 1) * base**place over each of some words that lie close together."""
        lo, n = int(starts[0]), int(ends[-1] - starts[0])
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.buf[lo : lo + n].astype(np.uint64) + _U(1)) * powers(n), out=sums[1:])
        return (sums[ends - lo] - sums[starts - lo]) * inverse_powers(n)[starts - lo]

    def _long_sum(self, start: int, end: int) -> np.uint64:
        """The same for one word longer than PIECE, by parts."""
        total = 0
        for lo in range(start, end, PIECE):
            part = self.buf[lo : min(end, lo + PIECE)].astype(np.uint64) + _U(1)
            total += int((part * powers(len(part))).sum(dtype=np.uint64)) * pow(int(_BASE), lo - start, 1 << 64)
        return _U(total & 0xFFFFFFFFFFFFFFFF)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, lo: int, hi: int) -> bytes:
        """Words lo to hi - 1, with one space between."""
        buf = self.buf
        return b" ".join(buf[s:e].tobytes() for s, e in zip(self.starts[lo:hi], self.ends[lo:hi], strict=True))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words; one of all the words if they are fewer than k, but some."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    size = min(k, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mix(out * _BASE + words[i : i + n - size + 1])
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int, each: Callable[[pa.RecordBatch], list]) -> Iterator[tuple[tuple, list]]:
    """Rows with equal first `keys` columns of longs, which stand one after the other: their key, and what `each` makes of them.

    `each` turns a batch into a list with an entry for each of its rows.
    """
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], dtype=np.int64)
        bounds = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1
        made = each(batch)
        for lo, hi in zip([0, *bounds.tolist()], [*bounds.tolist(), batch.num_rows], strict=True):
            key = tuple(columns[:, lo].tolist())
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.extend(made[lo:hi])
    if held:
        yield now, held


def byte_slices(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null: empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def pieces(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of up to `most` bytes (or one longer text), each with its first index."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, texts[lo:]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
