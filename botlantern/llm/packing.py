"""Sum-of-squares online packing of token streams into fixed windows.

A level array holds, for each fill level, how many windows stand at it. A document is put where
the sum of the squared counts of partly filled windows grows least (a new window counts as level
0; among equals the fullest wins). Each Spark task packs its own partition online, with no
shuffle: the windows of one task never mix with another's.

At the end of a partition the windows still open are repaired, which free cuts allow: the emptiest
are cut to fill the gaps of the fullest, and the last one is cut into windows whose lengths are
powers of two, which are stored without padding.

Defined cases: a null text is an empty one; every document, empty or not, has at least its end id,
hence a piece. Null or repeated ids are carried as they are; each row is packed for itself. Other
columns are ignored. An empty table gives no rows. A document longer than a window first fills
whole windows of its own; only what is left over is placed by level.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tokenizer_path
from .tokens import encoder

WINDOW = 4096
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_NEVER = 1 << 40

#: doc_id, start in the document, ids (little-endian uint32), tokens of the document
Piece = tuple[int | None, int, bytes, int]


class LevelPacker:
    """The online packer of one partition; `emit` gets each closed window's pieces."""

    def __init__(self, window: int, emit: Callable[[list[Piece]], None]):
        self.window, self.emit = window, emit
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def level_for(self, size: int) -> int:
        """The fill level, 0 for a new window, at which `size` more adds least to the sum of squares."""
        w, n = self.window, self.counts
        # Moving a window from h to h + size changes the sum by 2 * (n[h + size] - n[h] + 1), or, if
        # it then closes, by 1 - 2 * n[h]; a new one adds 2 * n[size] + 1.
        change = 2 * (n[1 + size : w + 1] - n[1 : w - size + 1] + 1)
        change[-1] = 1 - 2 * n[w - size]
        change[n[1 : w - size + 1] == 0] = _NEVER
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * n[size] + 1 else 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens, whole = len(ids) // 4, 0
        while tokens - whole >= self.window:
            self.emit([(doc_id, whole, ids[4 * whole : 4 * (whole + self.window)], tokens)])
            whole += self.window
        if size := tokens - whole:
            level = self.level_for(size)
            bin_ = self._take(level) if level else []
            bin_.append((doc_id, whole, ids[4 * whole :], tokens))
            self._put(level + size, bin_)

    def _take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        return self.open[level].pop()

    def _put(self, level: int, bin_: list[Piece]) -> None:
        if level == self.window:
            self.emit(bin_)
        else:
            self.counts[level] += 1
            self.open.setdefault(level, []).append(bin_)

    def finish(self) -> None:
        """Close the open windows: cut the emptiest to fill the fullest, then the last by powers of two."""
        bins = deque(b for level in sorted(self.open) for b in self.open[level])
        self.open, spare = {}, []
        while bins:
            bin_ = bins.pop()
            gap = self.window - _tokens(bin_)
            while gap and (spare or bins):
                spare = spare or bins.popleft()
                gap -= _move(spare, bin_, gap)
            if gap:
                self._tail(bin_)
            else:
                self.emit(bin_)
        self._tail(spare)

    def _tail(self, bin_: list[Piece]) -> None:
        while left := _tokens(bin_):
            room, out = 1 << (left.bit_length() - 1), []
            while room:
                room -= _move(bin_, out, room)
            self.emit(out)


def _tokens(bin_: list[Piece]) -> int:
    return sum(len(p[2]) for p in bin_) // 4


def _move(source: list[Piece], target: list[Piece], most: int) -> int:
    """Move the last piece of `source`, or its first `most` tokens, to the end of `target`."""
    doc_id, start, ids, tokens = source.pop()
    taken = min(most, len(ids) // 4)
    target.append((doc_id, start, ids[: 4 * taken], tokens))
    if 4 * taken < len(ids):
        source.append((doc_id, start + taken, ids[4 * taken :], tokens))
    return taken


def _packer(path: str, kind: str, window: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        part = TaskContext.get().partitionId() << 32
        made = 0

        def emit(pieces: list[Piece]) -> None:
            nonlocal made
            at = 0
            for doc_id, start, ids, tokens in pieces:
                n = len(ids) // 4
                rows.append((doc_id, start, n, ids, tokens, part + made, at))
                at += n
            made += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            rows.clear()
            return out

        packer, encode = LevelPacker(window, emit), encoder(path, kind).encode
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                packer.add(doc_id, ids + end)
            if rows:
                yield flush()
        packer.finish()
        if rows:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word_level", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in windows: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    `docs` has doc_id and text; `ids` are little-endian 32-bit ids. `sequence_id` holds the task's
    number in its upper half, so ids are unique without a second pass over the data.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packer(tokenizer, kind, window, end_id), SCHEMA)


def packed_digest(docs: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of the ids."""
    packed = pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
