"""Ingestion of log directories: a live stream of the newest files and an import of the older ones.

What a batch brings is one commit of the stored tables: raw records, dirty dates, images, and how far it
came, as the number of a micro-batch or as state and offsets of the import, and what is open. A batch that
was cut off leaves nothing; one that comes again after its commit changes nothing.

Both phases turn lines into records by the same plan. What a batch leaves open (calls, image requests, the
last mention and command) is a few lines in a folder that its commit names; they go in front of the next
batch, so records don't depend on batches. A batch's work is dealt by files: memory is carried inside a
file, then over one row for each file and key. The rollup is rebuilt
at the end of a batch; if that fails its markers stay and the next batch tries again.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import schemas
from ..config import Config
from ..operators.facts import add_counts
from ..operators.rollup import Rollup
from ..plans.parse import classified, events_of, known_of, on_disk, open_lines, outcome_of, records_of
from ..sources.logs import BotLogSource, Discovery, LogFile, budget_end, sort_key, stat_of
from ..sources.offsets import LogOffsets
from ..sources.tables import Change, State, Tables, kept, restored

# Waits after failures, in ms; later ones stay at the last.
BACKOFF_MS = (60_000, 300_000, 900_000, 3_600_000)
#: Bytes that are looked at together for the end of a file's last line.
TAIL_CHUNK = 64 << 10
OPEN = "stream string, file string, offset long, value string"
STATE_NAMES = [part.split(" ")[0] for part in schemas.IMPORT_STATE.split(", ")]


def _with_open(known: DataFrame, left: dict, config: Config) -> DataFrame:
    """Known events, after those that a batch before left open."""
    if not left:
        return known
    lines = known.sparkSession.read.schema(OPEN).parquet(left["path"])
    return known.unionByName(known_of(classified(events_of(lines), config)))


def _open_of(tables: Tables, key: str) -> dict:
    """What the last batch of a phase left open: a folder of lines, and of the import the file that is half read."""
    return (tables.state().states.get(key) or {}).get("values") or {}


class LiveIngest:
    """Follows the newest files of a log directory."""

    def __init__(self, spark: SparkSession, tables: Tables, checkpoint: str, config: Config):
        self.spark, self.tables, self.checkpoint, self.config = spark, tables, checkpoint, config
        self.rollup = Rollup(tables)
        self.query: StreamingQuery | None = None
        spark.dataSource.register(BotLogSource)

    def known(self) -> str:
        """The newest offset that Spark has planned in the checkpoint, as JSON; of a new one, that nothing was read."""
        log = f"{self.checkpoint.rstrip('/')}/offsets"
        numbers = [int(n) for n in self.tables._list(log) if n.isdigit()]
        found = [part for part in self.tables._text(f"{log}/{max(numbers)}").split("\n") if part.startswith('{"files"')] if numbers else []
        return found[0] if found else '{"files": {}}'

    def lines(self, backlog: bool = False) -> DataFrame:
        c = self.config
        options = {"backlog": backlog, "maxFiles": c.max_recent_files, "maxBytesPerFile": c.max_bytes_per_file_per_cycle, "maxLinesPerFile": c.log_read_batch_lines, "chunkBytes": c.log_read_chunk_bytes, "maxScanMs": c.max_scan_duration_ms, "known": self.known()}
        return self.spark.readStream.format("botlog").options(**options).load(c.log_directory)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        # Spark names the query by what its checkpoint says, so a new checkpoint is a new stream.
        stream = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or self.checkpoint
        if self.tables.state().batches.get(stream, -1) < batch_id:
            self._store(batch, stream, batch_id)
        self.rollup.recompute()
        self.tables.compact()

    def _store(self, batch: DataFrame, stream: str, batch_id: int) -> None:
        key, new = f"live {stream}", {"path": f"{self.tables.path('log_live_open')}/{uuid.uuid4().hex}"}
        left = _open_of(self.tables, key)
        known = on_disk(_with_open(batch, left, self.config))
        ai, images = (df.persist() for df in records_of(known, self.config))
        try:
            open_lines(known).coalesce(1).write.parquet(new["path"])

            def work(change: Change) -> None:
                if not change.done(stream, batch_id):
                    self.rollup.add(change, ai)
                    change.upsert("image_generation", images)
                    change.set_state(key, new)
                    change.batch(stream, batch_id)

            self.tables.commit(work)
        finally:
            for df in (ai, images, known):
                df.unpersist()
        gone = left if _open_of(self.tables, key) == new else new
        if gone:
            self.tables.remove(gone["path"])

    def _start(self, backlog: bool = False, **trigger) -> StreamingQuery:
        events = classified(events_of(self.lines(backlog)), self.config)
        outcome = outcome_of(F.col("status"), F.col("kind"))
        counts = [F.count_if(outcome == x).alias(x) for x in ("invalid", "ignored", "ai", "image")]
        rows = known_of(events.observe("outcomes", F.count("*").alias("lines"), *counts))
        self.query = rows.writeStream.foreachBatch(self.write).option("checkpointLocation", self.checkpoint).trigger(**trigger).start()
        return self.query

    def start(self) -> StreamingQuery:
        """Follow the directory until stopped; one query at a time."""
        if self.busy():
            return self.query
        return self._start(processingTime=f"{self.config.log_watch_interval_ms} milliseconds")

    def run_once(self) -> StreamingQuery:
        """Take what one micro-batch may take of what is there now, then end; nothing if a query is running."""
        if self.busy():
            return self.query
        query = self._start(availableNow=True)
        query.awaitTermination()
        return query

    def drain(self) -> int:
        """Take all that is there now, in bounded micro-batches and in the order of files; returns how many had rows.

        Files beyond max_recent_files are no exception: a new stream begins at the oldest file.
        """
        batches, before = 0, None
        while not self.busy() and (now := self.known()) != before:
            before = now
            query = self._start(backlog=True, availableNow=True)
            query.awaitTermination()
            batches += any(p["numInputRows"] for p in query.recentProgress)
        return batches

    def busy(self) -> bool:
        return bool(self.query and self.query.isActive)

    def stop(self) -> None:
        if self.busy():
            self.query.stop()


class HistoryImport:
    """Reads older files in order, batch by batch, with its progress in the table log_import_state.

    A batch takes whole lines of files, of each at most as many and as many bytes as the settings allow, up
    to the first file that is not read to its end; the cursor stays before that one, so the next batch goes
    on inside it. What a batch leaves open (calls, image requests, the last mention and command, how far
    the last file was read) is in the same commit as its records, and goes in front of the next batch, so
    records don't depend on batches.

    `run_once` takes one batch, for a cycle of a coordinator. `drain` takes all that is there: its batches
    hold as many ranges as a batch has files, each within the limits of a file, but a long file fills
    several of them, so few batches are needed however the lines are spread over files.
    """

    KEY, OPEN_KEY = "historical", "historical_open"
    #: Batches whose names a drain finds in one pass over the directory.
    PASS = 16

    def __init__(self, spark: SparkSession, tables: Tables, config: Config, now: Callable[[], float] = time.time):
        self.spark, self.tables, self.config, self.now = spark, tables, config, now
        self.rollup = Rollup(tables)
        self.offsets = LogOffsets(tables)
        self.running = False
        self._cancelled = threading.Event()
        self._tag = f"history-{uuid.uuid4().hex}"
        #: A pass over the directory that ran out of time, and its cursor.
        self.scan: tuple[str | None, Discovery] | None = None
        #: Names that a drain has found for its next batches.
        self.ahead: list[str] = []
        spark.dataSource.register(BotLogSource)

    def _blank(self) -> dict:
        return {part.split(" ")[0]: (0 if part.endswith("long") else None) for part in schemas.IMPORT_STATE.split(", ")} | {"key": self.KEY, "status": "idle"}

    def _state_of(self, base: State) -> dict:
        found = base.states.get(self.KEY)
        return {n: restored(v) for n, v in found["values"].items()} if found else self._blank()

    def state(self) -> dict:
        return self._state_of(self.tables.state())

    def _at(self) -> dt.datetime:
        return dt.datetime.fromtimestamp(self.now(), dt.timezone.utc).replace(tzinfo=None)

    def _patched(self, change: Change, changes: dict) -> dict:
        state = self._state_of(change.base)
        for name, value in changes.items():
            if name.endswith("_delta"):
                state[name.removesuffix("_delta")] = (state[name.removesuffix("_delta")] or 0) + value
            else:
                state[name] = value
        state["updatedAt"] = self._at()
        change.set_state(self.KEY, {n: kept(state[n]) for n in STATE_NAMES})
        return state

    def patch(self, **changes) -> dict:
        """Change fields; names with _delta are added to."""
        return self.tables.commit(lambda change: self._patched(change, changes))

    def first_cursor(self) -> str | None:
        """In mode `recent`, files of the last days only, the first of them whole."""
        if self.config.historical_import_mode != "recent":
            return None
        day = self._at().date() - dt.timedelta(days=self.config.historical_import_days + 1)
        return f"{day.isoformat()}-{10**15}.log"

    def _fail(self, error: Exception) -> dict:
        failures = (self.state()["consecutiveFailures"] or 0) + 1
        wait = BACKOFF_MS[min(failures, len(BACKOFF_MS)) - 1]
        retry = self._at() + dt.timedelta(milliseconds=wait)
        return self.patch(status="failed", failedAt=self._at(), nextRetryAt=retry, consecutiveFailures=failures, lastError=str(error)[:1023])

    def _cursor(self, state: dict) -> str | None:
        names = [n for n in (state["cursorFileName"], self.first_cursor()) if n]
        return max(names, key=sort_key, default=None)

    def _files(self, cursor: str | None, batches: int = 1) -> list[LogFile] | None:
        """The next files, or None if the pass over the directory ran out of time."""
        most = batches * self.config.max_historical_files_per_batch
        if not self.scan or (self.scan[0], self.scan[1].most) != (cursor, most):
            self.scan = cursor, Discovery(self.config.log_directory, most, after=cursor)
        try:
            files = self.scan[1].advance(self.config.max_scan_duration_ms / 1000)
        except Exception:
            self.scan = None
            raise
        if files is not None:
            self.scan = None
        return files

    def _ahead(self, cursor: str | None) -> list[LogFile] | None:
        """The same for a drain, whose passes find names for several batches."""
        while True:
            self.ahead = [n for n in self.ahead if cursor is None or sort_key(n) > sort_key(cursor)]
            # Files have grown since the pass, or are gone.
            if files := stat_of(self.config.log_directory, self.ahead[: self.config.max_historical_files_per_batch]):
                return files
            if not (files := self._files(cursor, self.PASS)):
                return files
            self.ahead = [f.name for f in files]

    def _ranges(self, files: list[LogFile], begun: dict[str, int], through: bool = False) -> list[tuple[LogFile, int, int]]:
        """Whole lines (file, start, end) of the files, within the limits, up to the first that is not read to its end.

        `through`: a file has as many ranges as it takes, up to as many in all as a batch has files.
        """
        c, found = self.config, []
        for f in files:
            start = begun.get(f.name, 0)
            end = start = start if start <= f.size else 0
            while True:
                start, end = end, budget_end(os.path.join(c.log_directory, f.name), end, f.size, c.max_bytes_per_file_per_cycle, c.log_read_batch_lines, TAIL_CHUNK)
                if end > start or not found or found[-1][0] != f:
                    found.append((f, start, end))
                if not through or not start < end < f.size or len(found) >= c.max_historical_files_per_batch:
                    break
            if end < f.size or len(found) >= c.max_historical_files_per_batch:
                break
        return found

    def _idle(self, state: dict) -> bool:
        """Whether there is nothing to do by this state."""
        waits = state["status"] == "failed" and state["nextRetryAt"] and self._at() < state["nextRetryAt"]
        return bool(self.running or self.config.historical_import_mode == "disabled" or state["status"] in ("completed", "paused") or waits)

    @contextlib.contextmanager
    def _busy(self) -> Iterator[None]:
        self.running = True
        self._cancelled.clear()
        self.spark.sparkContext.addJobTag(self._tag)
        try:
            yield
        finally:
            self.spark.sparkContext.removeJobTag(self._tag)
            self.running = False

    def _batch(self, state: dict, through: bool = False) -> dict:
        try:
            files = (self._ahead if through else self._files)(self._cursor(state))
            if state["status"] == "idle":
                state = self.patch(status="running", startedAt=self._at())
            if files is None:
                return state
            if not files:
                return self.patch(status="completed", completedAt=self._at())
            ranges = self._ranges(files, self._begun(), through)
            if not any(end - start or end >= f.size for f, start, end in ranges):
                return state  # the next file has no whole line yet
            after = self.load(ranges, state)
            if not through:
                self._settle()
            return after
        except Exception as error:
            return self.state() if self._cancelled.is_set() else self._fail(error)

    def _settle(self) -> None:
        """Rebuild the rollup of what batches brought, and merge layers."""
        self.rollup.recompute()
        self.tables.compact()

    def run_once(self) -> dict:
        """One batch of files; returns the state after it."""
        state = self.state()
        if self._idle(state):
            return state
        if state["status"] == "failed":
            state = self.patch(status="running", lastError=None)
        with self._busy():
            return self._batch(state)

    def drain(self) -> dict:
        """Batch after batch until all that is there is imported, or one fails or is cancelled; returns the state after it.

        The rollup is rebuilt once, at the end: until then the dates of the batches stay marked, so a drain that was cut off is
        mended by the next batch or drain. Names are found for several batches at a time; of files that come while
        it runs, only those behind these names are seen.
        """
        state = self.state()
        if self._idle(state):
            return state
        if state["status"] == "failed":
            state = self.patch(status="running", lastError=None)
        self.ahead, before = [], None
        with self._busy():
            while state["status"] in ("idle", "running") and not self._cancelled.is_set() and (self.scan or state != before):
                before, state = state, self._batch(state, through=True)
            if not self._cancelled.is_set():
                self._settle()
        return state

    def cancel(self) -> None:
        """End the jobs of a batch that is running; its commit is made whole or not at all, and it is no failure."""
        self._cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self._tag)

    def _left(self) -> dict:
        return _open_of(self.tables, self.OPEN_KEY)

    def _begun(self) -> dict[str, int]:
        left = self._left()
        return {left["file"]: left["offset"]} if left.get("file") else {}

    def load(self, ranges: list[tuple[LogFile, int, int]], state: dict) -> dict:
        """Parse lines (file, start, end) as one batch, after what the last batch left open, and commit what they bring; the state after it."""
        left, new = self._left(), {"path": f"{self.tables.path('log_import_open')}/{uuid.uuid4().hex}"}
        read = f"{self.tables.path('log_import_open')}/{uuid.uuid4().hex}"
        parts = json.dumps([(f.name, start, end) for f, start, end in ranges])
        lines = self.spark.read.format("botlog").option("ranges", parts).load(self.config.log_directory)
        whole = [f for f, _, end in ranges if end >= f.size]
        last, _, end = ranges[-1]
        if end < last.size:
            new |= {"file": last.name, "offset": end}
        if left:
            lines = lines.unionByName(self.spark.read.schema(OPEN).parquet(left["path"]))
        found = known_of(classified(events_of(lines), self.config))
        cached: list[DataFrame] = []
        try:
            # As a table of its own, so that the plans of records, which use it often, are short.
            found.write.parquet(read)
            known = self.spark.read.schema(found.schema).parquet(read)
            cached += (df.persist() for df in records_of(known, self.config))
            ai, images = cached
            counts = ai.count(), images.count()
            open_lines(known).coalesce(1).write.parquet(new["path"])

            def work(change: Change) -> dict:
                now = self._state_of(change.base)
                if (now["cursorFileName"], now["processedBytes"]) != (state["cursorFileName"], state["processedBytes"]) or now["status"] != "running":
                    return now  # another importer was here, or a reset
                self.rollup.add(change, ai)
                change.upsert("image_generation", images)
                if end < last.size:
                    change.upsert("log_offset", self.offsets.row(last.name, last.size, end, last.mtime_ms))
                change.set_state(self.OPEN_KEY, new)
                if self._cancelled.is_set():
                    raise RuntimeError("cancelled")
                return self._patched(change, {
                    "cursorFileName": whole[-1].name if whole else now["cursorFileName"], "processedFiles_delta": len(whole), "processedBytes_delta": sum(e - s for _, s, e in ranges),
                    "importedAiRecords_delta": counts[0], "importedImageRecords_delta": counts[1], "consecutiveFailures": 0, "failedAt": None, "nextRetryAt": None, "lastError": None,
                })

            after = self.tables.commit(work)
        finally:
            for df in cached:
                df.unpersist()
            self.tables.remove(read)
        gone = left if self._left().get("path") == new["path"] else new
        if gone:
            self.tables.remove(gone["path"])
        return after

    def reset(self) -> str:
        """Start over, unless a batch is running; records that come again replace their equals."""
        if self.running:
            return "busy"

        def work(change: Change) -> None:
            self._patched(change, self._blank())
            change.set_state(self.OPEN_KEY, {})

        self.tables.commit(work)
        self.scan = None
        return "ok"


class CycleLog(StreamingQueryListener):
    """Gives a key=value line for each micro-batch to a function."""

    def __init__(self, say: Callable[[str], None] = print):
        self.say = say

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = {"batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration}
        for row in (p.observedMetrics or {}).values():
            found |= row.asDict()
        self.say("ingest " + " ".join(f"{k}={v}" for k, v in found.items()))

    def onQueryTerminated(self, event) -> None:
        pass


class CountFlush:
    """Hourly counts of a stream of events, stored when an interval is over, when the hour changes, or on demand.

    Each micro-batch writes its counts beside the table, by its number, so a batch that is repeated counts
    once. A flush adds up all that is there since the last one and commits sums and the last number
    together: counted twice or lost is nothing, wherever it is cut off.
    """

    def __init__(self, tables: Tables, name: str, facts: Callable[[DataFrame], DataFrame], checkpoint: str, interval_ms: int = 600_000, now: Callable[[], float] = time.time):
        self.tables, self.name, self.facts, self.checkpoint, self.interval_ms, self.now = tables, name, facts, checkpoint, interval_ms, now
        self.last = now()
        self.folder, self.stream = f"{tables.path(name)}_waiting", f"flush {checkpoint}"
        self._one = threading.Lock()

    def start(self, events: DataFrame, every_ms: int = 10_000, once: bool = False) -> StreamingQuery:
        trigger = {"availableNow": True} if once else {"processingTime": f"{every_ms} milliseconds"}
        return events.writeStream.foreachBatch(self.write).option("checkpointLocation", self.checkpoint).trigger(**trigger).start()

    def write(self, batch: DataFrame, number: int) -> None:
        with self._one:
            if self.tables.state().batches.get(self.stream, -1) < number:
                self.facts(batch).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        if self.due():
            self.flush()

    def due(self) -> bool:
        hour = lambda at: dt.datetime.fromtimestamp(at, dt.timezone.utc).replace(minute=0, second=0, microsecond=0)
        return self.now() - self.last > self.interval_ms / 1000 or hour(self.now()) != hour(self.last)

    def _waiting(self) -> list[int]:
        """Micro-batches that are written to their end and not flushed yet."""
        done = self.tables.state().batches.get(self.stream, -1)
        found = [int(n.removeprefix("batch=")) for n in self.tables._list(self.folder) if n.startswith("batch=")]
        return sorted(n for n in found if n > done and self.tables.exists(f"{self.folder}/batch={n}"))

    def waiting(self) -> DataFrame | None:
        """Counts that are not flushed yet."""
        parts = [f"{self.folder}/batch={n}" for n in self._waiting()]
        return add_counts(self.tables.spark.read.parquet(*parts), key=schemas.PRIMARY_KEYS[self.name]) if parts else None

    def flush(self) -> list[int]:
        """Store what waits; returns the micro-batches that it was."""
        with self._one:
            numbers = self._waiting()
            if numbers:
                rows = self.tables.spark.read.parquet(*[f"{self.folder}/batch={n}" for n in numbers])
                self.tables.add_counts(self.name, rows, self.stream, numbers[-1])
            self.last = self.now()
            done = self.tables.state().batches.get(self.stream, -1)
            for n in self.tables._list(self.folder):
                if n.startswith("batch=") and int(n.removeprefix("batch=")) <= done:
                    self.tables.remove(f"{self.folder}/{n}")
            return numbers


def flush_counts(events: DataFrame, tables: Tables, name: str, facts: Callable[[DataFrame], DataFrame], checkpoint: str, interval_ms: int = 600_000, once: bool = False) -> StreamingQuery:
    """Store the hourly counts of a stream of events at each interval and at each change of the hour."""
    return CountFlush(tables, name, facts, checkpoint, interval_ms).start(events, once=once)


def flushed_counts(tables: Tables, name: str) -> DataFrame:
    """What is stored, and what waits for the next flush."""
    key, folder = schemas.PRIMARY_KEYS[name], f"{tables.path(name)}_waiting"
    parts = [f"{folder}/{n}" for n in tables._list(folder) if n.startswith("batch=") and tables.exists(f"{folder}/{n}")]
    stored = tables.read(name).select(*key, "count")
    return add_counts(stored, tables.spark.read.parquet(*parts), key=key) if parts else stored
