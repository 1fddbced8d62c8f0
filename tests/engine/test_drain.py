"""A drained history: long files take few batches, each within limits, and the records are those of a sequential parser."""

import time
from pathlib import Path

import duckdb
import pytest

from botlantern.config import Config
from botlantern.operators.rollup import Rollup
from botlantern.sources.logs import sort_key
from botlantern.sources.tables import Tables
from botlantern.streaming.ingest import HistoryImport

from .test_commits import rollup_is_right
from .test_equal_ids import equals_its_sql
from .test_ingest import requests, stored, unique, write_log
from .test_logs import random_log, simulate
from .test_queries import SF


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/tables")


@pytest.fixture
def loads(monkeypatch):
    """The ranges (name, start, end) of each batch that is loaded."""
    found, real = [], HistoryImport.load

    def load(self, ranges, state):
        found.append([(f.name, start, end) for f, start, end in ranges])
        return real(self, ranges, state)

    monkeypatch.setattr(HistoryImport, "load", load)
    return found


def test_long_files_take_few_batches_of_the_query(spark, tmp_path, loads):
    """Four files of more than twice the lines that a cycle takes of a file: 9 batches, were a batch to end inside each."""
    some = f"(from '{SF}/events.parquet' where ts < '2024-01-01 08:00:00')"
    copies = 4 * 110_000 // duckdb.connect().execute(f"select count(*) from {some}").fetchall()[0][0]
    duckdb.connect().execute(f"copy (select event_id + i * 1000000 as event_id, ts, user_id, event_type, value, props from {some}, range({copies}) t(i)) to '{tmp_path}/events.parquet'")
    equals_its_sql(spark, str(tmp_path), "t_history_import")
    assert len(loads) == 1 and len({name for name, _, _ in loads[0]}) == 4 and len(loads[0]) > 8


def test_a_drain_is_read_within_limits(spark, tables, tmp_path, loads):
    lines, folder = random_log(12, 260), tmp_path / "logs"
    write_log(folder, lines, 180)
    h = HistoryImport(spark, tables, Config(log_directory=str(folder), historical_import_mode="full", log_read_batch_lines=50, max_historical_files_per_batch=3))
    assert h.drain()["status"] == "completed" and h.state()["processedFiles"] == 2
    taken = [[(folder / name).read_bytes()[start:end].count(b"\n") for name, start, end in batch] for batch in loads]
    assert taken == [[50, 50, 50], [30, 50, 30]]
    assert h.state()["processedBytes"] == sum(f.stat().st_size for f in folder.iterdir())
    want = simulate(lines)
    assert stored(tables) == (unique(want[0]), unique(want[1])) and rollup_is_right(tables) and Rollup(tables).pending() == []
    # Only what is still open is left beside the tables.
    assert len(list(Path(f"{tmp_path}/tables/log_import_open").iterdir())) == 1
    assert h.drain()["status"] == "completed" and len(loads) == 2


def test_a_drain_ends_at_a_file_without_an_end_and_goes_on_later(spark, tables, tmp_path):
    lines, folder = random_log(5, 90), tmp_path / "logs"
    write_log(folder, lines, 30)
    half = folder / "2024-01-01-2.log"
    whole = half.read_bytes()
    half.write_bytes(whole[: len(whole) // 2])
    h = HistoryImport(spark, tables, Config(log_directory=str(folder), historical_import_mode="full", max_historical_files_per_batch=5))
    start = time.monotonic()
    state = h.drain()
    assert (state["status"], state["cursorFileName"]) == ("running", "2024-01-01-1.log") and time.monotonic() - start < 120
    half.write_bytes(whole)
    # One that is cancelled leaves nothing and ends the drain.
    real = tables.write_layer
    tables.write_layer = lambda name, rows: h.cancel() or real(name, rows)
    assert h.drain()["processedFiles"] == 1 and not h.running
    tables.write_layer = real
    assert h.drain()["status"] == "completed" and h.state()["processedFiles"] == 3
    want = simulate(lines)
    assert stored(tables) == (unique(want[0]), unique(want[1])) and rollup_is_right(tables)


def test_names_of_several_batches_are_found_in_one_pass(spark, tables, tmp_path, monkeypatch):
    names = sorted((f"2024-01-{d:02}-{i}.log" for d in range(1, 8) for i in range(1, 12)), key=sort_key)
    for n in names:
        (tmp_path / n).write_text("x\n")
    h = HistoryImport(spark, tables, Config(log_directory=str(tmp_path), historical_import_mode="full", max_historical_files_per_batch=4))
    real, passes, got, cursor = h._files, [], [], None
    monkeypatch.setattr(h, "_files", lambda *a: passes.append(a) or real(*a))
    while files := h._ahead(cursor):
        if not got:
            (tmp_path / names[5]).unlink()  # gone since the pass
        got += [f.name for f in files]
        cursor = got[-1]
    assert got == names[:5] + names[6:] and len(passes) == 3


def test_small_files_have_small_filters(spark, tables):
    tables.upsert_dated("ai_request", requests(spark, [(f"r{i}", 10 + i % 3, None, "m", 5, True) for i in range(30)]))
    found = list(Path(tables.path("ai_request").removeprefix("file://")).rglob("*.parquet"))
    assert len(found) == 3 and all(f.stat().st_size < 50_000 for f in found)
