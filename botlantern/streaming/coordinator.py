"""One ingestion for a log directory: in each cycle the live phase, then the historical one.

Cycles never overlap. One that is asked for while another runs is skipped, with a warning at most every
`BUSY_LOG_MS`. Each phase has its own parser state and its own failures: what goes wrong in the live phase
stops no import. `dispose` ends both phases and their Spark jobs; what they had not committed comes again.

Coordinators of several processes may share tables: commits of the tables detect each other, streams
count micro-batches once, and an import whose batch another one has taken leaves its own.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..config import Config
from ..sources.tables import Tables
from .ingest import HistoryImport, LiveIngest

log = logging.getLogger(__name__)
# Fixed value: a busy warning is given once in this time.
BUSY_LOG_MS = 300_000


class Coordinator:
    def __init__(self, spark: SparkSession, tables: Tables, checkpoint: str, config: Config, now: Callable[[], float] = time.time, warn: Callable[[str], None] = log.warning):
        self.config, self.now, self.warn = config, now, warn
        self.live = LiveIngest(spark, tables, checkpoint, config)
        self.history = HistoryImport(spark, tables, config, now)
        self.disposed = False
        self._running = threading.Lock()
        self._wake = threading.Event()
        self._thread: threading.Thread | None = None
        self._warned: float | None = None

    @property
    def running(self) -> bool:
        return self._running.locked()

    def tick(self, source: str = "manual") -> bool:
        """One cycle; False if it was skipped."""
        if self.disposed:
            return False
        if not self._running.acquire(blocking=False):
            if self._warned is None or self.now() - self._warned >= BUSY_LOG_MS / 1000:
                self._warned = self.now()
                self.warn(f"ingest busy_skip source={source}: the cycle before it is still running")
            return False
        try:
            for phase, run in (("live", self.live.run_once), ("history", self.history.run_once)):
                if self.disposed:
                    break
                try:
                    run()
                except Exception as error:
                    if not self.disposed:
                        self.warn(f"ingest failed phase={phase} error={error}")
        finally:
            self._running.release()
        return True

    def start(self) -> None:
        """A cycle now, and one in each interval until disposed."""

        def loop() -> None:
            source = "ready"
            while not self.disposed:
                self.tick(source)
                source = "interval"
                self._wake.wait(self.config.log_watch_interval_ms / 1000)

        if self._thread is None and not self.disposed:
            self._thread = threading.Thread(target=loop, name="ingest", daemon=True)
            self._thread.start()

    def reset_history(self) -> str:
        """Start the import over, unless a cycle is running."""
        if not self._running.acquire(blocking=False):
            return "busy"
        try:
            return self.history.reset()
        finally:
            self._running.release()

    def dispose(self, timeout: float = 60) -> None:
        """End for good: running jobs are cancelled."""
        self.disposed = True
        self._wake.set()
        self.live.stop()
        self.history.cancel()
        if self._thread is not None and self._thread is not threading.current_thread():
            self._thread.join(timeout)
