"""The `botlog` data source: directories of daily log files, `YYYY-MM-DD-N.log`, that are appended to.

    spark.dataSource.register(BotLogSource)
    spark.read.format("botlog").load(path)          # all files, or options names or ranges
    spark.readStream.format("botlog").load(path)    # newest maxFiles files, as they grow

Rows: stream (the directory), file, offset (bytes), value (a line). Lines are split on bytes and
decoded after, so no character is cut; carriage returns and blanks around a line go, blank lines are
dropped. Executors read the directory by the same path as the driver, so it must be a shared one.

Streaming offsets hold, for each file that is followed, how far it was read and its size and time,
so a file that shrank or went back in time is read anew. Only lines that end with a newline are
read; a batch takes at most maxBytesPerFile bytes and maxLinesPerFile lines of a file, but always one
line at least. Spark does not tell a Python source where a restarted query stands; the option known,
the newest offset of its checkpoint as JSON, does, so limits hold for the first batch as well.

With the option backlog, which needs known, no file of the directory is passed over, however many there
are: a batch takes what is new in the files that are followed, or else the oldest maxFiles files that
were not read yet; it ends at the first file that its limits leave half read, and the next one goes on
inside it. So lines come in the order of their files. Offsets then hold at most twice as many files. A
file that comes late, behind maxFiles later ones that were read, is left out, as one that was let go.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_NAME = re.compile(r"(\d{4})-(\d{2})-(\d{2})-(\d+)\.log")
#: Bytes that one task reads of a large file.
SPLIT = 64 << 20
#: Bytes up to which one task reads several small files.
PACK = 1 << 20
CHUNK = 1 << 20
#: Lines that go to Spark at once.
BATCH = 4096

SortKey = tuple[int, int, str]


def sort_key(name: str) -> SortKey:
    """By date, then number; other names come first."""
    m = _NAME.fullmatch(name)
    return (int(m[1] + m[2] + m[3]), int(m[4]), name) if m else (0, 0, name)


@dataclass(frozen=True)
class LogFile:
    name: str
    size: int
    mtime_ms: int


def log_names(path: str) -> Iterator[str]:
    """Names of the log files of a directory, one by one; an error ends the listing as an error."""
    with os.scandir(path) as entries:
        for e in entries:
            if e.name.endswith(".log") and e.is_file():
                yield e.name


def stat_of(path: str, names: Iterable[str]) -> list[LogFile]:
    """Files with size and time; those that vanished meanwhile are left out."""
    found = []
    for name in names:
        try:
            s = os.stat(os.path.join(path, name))
        except FileNotFoundError:
            continue
        found.append(LogFile(name, s.st_size, s.st_mtime_ns // 1_000_000))
    return found


def discover_recent(path: str, most: int, names: Callable[[str], Iterable[str]] = log_names) -> list[LogFile]:
    """The newest files by key, oldest first; only these are looked up. A failed listing gives nothing."""
    return stat_of(path, sorted(heapq.nlargest(most, names(path), key=sort_key), key=sort_key))


def discover_after(path: str, cursor: str | None, most: int, names: Callable[[str], Iterable[str]] = log_names) -> list[LogFile]:
    """The oldest files whose key is greater than the cursor's, in order."""
    later = (n for n in names(path) if cursor is None or sort_key(n) > sort_key(cursor))
    return stat_of(path, heapq.nsmallest(most, later, key=sort_key))


class Discovery:
    """A pass over a directory that may be interrupted: the newest files, or the oldest after a cursor.

    Only names are held, at most twice as many as wanted. What is found is given when the pass has come
    to its end, so it never depends on how often the pass was interrupted.
    """

    #: Names between looks at the clock.
    STEP = 1000

    def __init__(self, path: str, most: int, after: str | None = None, newest: bool = False, names: Callable[[str], Iterable[str]] = log_names):
        self.path, self.most, self.after, self.newest = path, most, after, newest
        self.names, self.found = iter(names(path)), []

    def _best(self) -> list[str]:
        return (heapq.nlargest if self.newest else heapq.nsmallest)(self.most, self.found, key=sort_key)

    def advance(self, seconds: float | None = None, clock: Callable[[], float] = time.monotonic) -> list[LogFile] | None:
        """The files in order, or None if the time ran out first; the next call goes on from there."""
        end = None if seconds is None else clock() + seconds
        for i, name in enumerate(self.names, 1):
            if self.after is None or sort_key(name) > sort_key(self.after):
                self.found.append(name)
                if len(self.found) >= 2 * self.most:
                    self.found = self._best()
            if end is not None and i % self.STEP == 0 and clock() >= end:
                return None
        return stat_of(self.path, sorted(self._best(), key=sort_key))


def read_lines(file: str, start: int, end: int, tail: bool = False, chunk: int = CHUNK) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that begin in [start, end); `tail`: one without a newline, too.

    A start inside a line belongs to the reader of the bytes before it.
    """
    if chunk <= 0:
        raise ValueError("chunk must be positive")
    with open(file, "rb") as f:
        at = max(0, start - 1)
        f.seek(at)
        skip, rest = start > 0, b""
        while True:
            data = f.read(chunk)
            if not data:
                break
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            for raw in lines:
                begin, at = at, at + len(raw) + 1
                if skip:
                    skip = False
                    continue
                if begin >= end:
                    return
                if line := raw.decode("utf-8", "replace").strip():
                    yield begin, line
            if not skip and at >= end:
                return
        if tail and not skip and at < end and (line := rest.decode("utf-8", "replace").strip()):
            yield at, line


def last_line_end(file: str, start: int, end: int, chunk: int = CHUNK) -> int:
    """The end of the last whole line in [start, end), or of the first line after it; start if there is none."""
    with open(file, "rb") as f:
        at = end
        while at > start:
            lo = max(start, at - chunk)
            f.seek(lo)
            found = f.read(at - lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            at = lo
        # A line longer than the limit is taken whole.
        f.seek(end)
        at = end
        while data := f.read(chunk):
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
    return start


def budget_end(file: str, start: int, end: int, most_bytes: int, most_lines: int, chunk: int = CHUNK) -> int:
    """Where to stop reading whole lines of [start, end): within so many bytes and lines, but after one line at least."""
    to = last_line_end(file, start, min(end, start + most_bytes), chunk)
    with open(file, "rb") as f:
        f.seek(start)
        at = start
        while at < to and (data := f.read(min(chunk, to - at))):
            lines = data.count(b"\n")
            if lines < most_lines:
                most_lines -= lines
                at += len(data)
                continue
            place = -1
            for _ in range(most_lines):
                place = data.index(b"\n", place + 1)
            return at + place + 1
    return to


@dataclass
class LogRanges(InputPartition):
    """Ranges (name, start, end) of files of one directory."""

    stream: str
    ranges: list[tuple[str, int, int]]
    tail: bool = False


def _packed(stream: str, ranges: Iterable[tuple[str, int, int]], tail: bool = False) -> list[LogRanges]:
    """Tasks for ranges of files: large ones are split, small ones share a task."""
    parts, size = [], PACK
    for name, start, end in ranges:
        for a in range(start, end, SPLIT):
            b = min(end, a + SPLIT)
            if size + b - a > PACK:
                parts.append(LogRanges(stream, [], tail))
                size = 0
            parts[-1].ranges.append((name, a, b))
            size += b - a
    return parts


def _read(part: LogRanges, chunk: int) -> Iterator[tuple]:
    for name, start, end in part.ranges:
        for offset, line in read_lines(os.path.join(part.stream, name), start, end, part.tail, chunk):
            yield part.stream, name, offset, line


def _batches(part: LogRanges, chunk: int) -> Iterator[pa.RecordBatch]:
    """The same rows, whose columns Spark takes as they are."""
    rows = _read(part, chunk)
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*some, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["stream", "file", "offset", "value"])


class BotLogReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path = path
        self.chunk = int(options.get("chunkbytes", CHUNK))
        self.names = [n for n in options.get("names", "").split(",") if n]
        self.ranges = json.loads(options.get("ranges", "null"))
        self.newest_tail = options.get("tail", "true").lower() == "true"

    def partitions(self) -> list[LogRanges]:
        if self.ranges is not None:  # name, start and end of whole lines
            return _packed(self.path, self.ranges)
        files = stat_of(self.path, self.names or log_names(self.path))
        files.sort(key=lambda f: sort_key(f.name))
        return _packed(self.path, [(f.name, 0, f.size) for f in files], self.newest_tail)

    def read(self, partition: LogRanges) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.chunk)


class BotLogStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path = path
        self.chunk = int(options.get("chunkbytes", CHUNK))
        self.files = int(options.get("maxfiles", 64))
        self.bytes = int(options.get("maxbytesperfile", 8 << 20))
        self.lines = int(options.get("maxlinesperfile", sys.maxsize))
        self.seconds = int(options.get("maxscanms", 120_000)) / 1000
        if min(self.chunk, self.files, self.bytes, self.lines, self.seconds) <= 0:
            raise ValueError("limits must be positive")
        #: A pass over the directory that ran out of time.
        self.scan: Discovery | None = None
        #: What was planned last; where a restart does not know it, files are taken to their ends.
        self.known: dict | None = json.loads(options.get("known", "null"))
        self.backlog = options.get("backlog", "false").lower() == "true"
        if self.backlog and self.known is None:
            raise ValueError("backlog needs known")

    def initialOffset(self) -> dict:
        self.known = {"files": {}}
        return {"files": {}}

    @staticmethod
    def _from(before: dict | None, size: int, mtime: int) -> int:
        """Where to go on in a file: at 0 if it is new, shrank, or went back in time by over a second."""
        if not before or size < before["size"] or size < before["pos"] or mtime + 1000 < before["mtime"]:
            return 0
        return before["pos"]

    def _ends(self, files: list[LogFile], known: dict | None, ordered: bool = False) -> dict:
        """How far to read each file, after what is known of it; `ordered`: up to the first that is left half read."""
        found = {}
        for f in files:
            file = os.path.join(self.path, f.name)
            start = self._from(known.get(f.name), f.size, f.mtime_ms) if known is not None else 0
            try:
                pos = budget_end(file, start, f.size, self.bytes, self.lines, self.chunk) if known is not None else last_line_end(file, start, f.size, self.chunk)
                half = ordered and pos < last_line_end(file, start, f.size, self.chunk)
            except FileNotFoundError:
                continue
            found[f.name] = {"pos": pos, "size": f.size, "mtime": f.mtime_ms}
            if half:
                break
        return found

    def _next(self) -> dict:
        """The next offset of a backlog; the known one if there is nothing new."""
        known = self.known["files"]
        names = sorted(known, key=sort_key)
        followed = known | self._ends(stat_of(self.path, names), known, ordered=True)
        if followed != known:
            return {"files": followed}
        # Files that were let go are older than all that are kept.
        kept = names[-self.files :]
        oldest = kept[0] if len(kept) == self.files else None
        unread = Discovery(self.path, self.files, after=oldest, names=lambda path: (n for n in log_names(path) if n not in known)).advance()
        new = self._ends(unread, {}, ordered=True)
        return {"files": {n: known[n] for n in kept} | new} if new else self.known

    def latestOffset(self) -> dict:
        if self.backlog:
            self.known = self._next()
            return self.known
        self.scan = self.scan or Discovery(self.path, self.files, newest=True)
        files = self.scan.advance(self.seconds)
        # Until the pass has come to its end there is nothing new.
        while files is None and self.known is None:
            files = self.scan.advance(self.seconds)
        if files is None:
            return self.known
        self.scan = None
        self.known = {"files": self._ends(files, self.known["files"] if self.known else None)}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[LogRanges]:
        parts = []
        for name, to in sorted(end["files"].items(), key=lambda x: sort_key(x[0])):
            begin = self._from(start["files"].get(name), to["size"], to["mtime"])
            if begin > to["pos"]:
                begin = 0
            parts.append((name, begin, to["pos"]))
        return _packed(self.path, parts)

    def read(self, partition: LogRanges) -> Iterator[tuple]:
        return _read(partition, self.chunk)


class BotLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "botlog"

    def schema(self) -> str:
        return "stream string, file string, offset long, value string"

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("botlog needs a path")
        return path.removeprefix("file://").rstrip("/") or "/"

    def reader(self, schema) -> BotLogReader:
        return BotLogReader(self._path(), dict(self.options))

    def streamReader(self, schema) -> BotLogStreamReader:
        return BotLogStreamReader(self._path(), dict(self.options))
