"""Commits of stored tables: two writers, crashes, layers and their compaction; the coordinator and the limits of a cycle."""

import json
import random
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from botlantern.config import Config
from botlantern.operators.ai import model_daily
from botlantern.operators.rollup import Rollup
from botlantern.sources import tables as stored_tables
from botlantern.sources.logs import BotLogStreamReader, budget_end
from botlantern.sources.offsets import LogOffsets
from botlantern.sources.tables import Conflict, Tables
from botlantern.streaming.coordinator import Coordinator
from botlantern.streaming.ingest import CountFlush, HistoryImport, LiveIngest, flushed_counts

from .test_ingest import daily, requests, stored, unique, write_log
from .test_logs import random_log, simulate


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/tables")


def ids(tables):
    return sorted(r.id for r in tables.read("ai_request").select("id").collect())


def files(tables, name):
    return sorted(str(p) for p in Path(tables.path(name).removeprefix("file://")).rglob("*.parquet"))


def rollup_is_right(tables):
    rows = lambda df: sorted(map(tuple, df.select("date", "source", "provider", "modelId", "requestCount", "totalTokens").collect()))
    return rows(tables.read("ai_model_daily")) == rows(model_daily(tables.read("ai_request")))


def test_rows_of_interleaved_writers_are_all_kept(spark, tables):
    a, b = Tables(spark, tables.root), Tables(spark, tables.root)
    one, two = requests(spark, [("a", 10, None, "m", 5, True), ("x", 10, None, "m", 1, True)]), requests(spark, [("b", 10, None, "m", 7, True), ("x", 10, None, "m", 2, True)])

    def slow(change):
        Rollup(a).add(change, one)
        Rollup(b).record(two)  # between a's reading and its commit

    a.commit(slow)
    assert ids(tables) == ["a", "b", "x"] and Rollup(tables).pending() == [10]
    # a committed last, so its row stands.
    assert {r.id: r.totalTokens for r in tables.read("ai_request").collect()} == {"a": 5, "b": 7, "x": 1}


def test_marks_that_come_during_a_rebuild_stay(spark, tables):
    r, other = Rollup(tables), Rollup(Tables(spark, tables.root))
    r.record(requests(spark, [("a", 10, None, "m", 5, True)]))
    real, calls = r.rebuild, []

    def rebuild(dates):
        n = real(dates)
        if not calls:
            calls.append(other.record(requests(spark, [("b", 10, None, "m", 7, True)])))
        return n

    r.rebuild = rebuild
    assert r.recompute().pending_after == [10]
    assert r.recompute().pending_after == [] and daily(tables) == [(10, "", "m", 2, 2, 0, 12)]


def test_a_rebuild_that_read_old_records_is_done_anew(spark, tables):
    r, other = Rollup(tables), Rollup(Tables(spark, tables.root))
    r.record(requests(spark, [("a", 10, None, "m", 5, True)]))
    real, calls = tables.write_layer, []

    def write(name, rows):
        made = real(name, rows)
        if name == "ai_model_daily" and not calls:
            calls.append(1)
            other.record(requests(spark, [("b", 10, None, "m", 7, True)]))
            other.recompute()
        return made

    tables.write_layer = write
    r.recompute()
    assert daily(tables) == [(10, "", "m", 2, 2, 0, 12)] and not r.has_pending_dates()


def test_many_threads_lose_nothing(spark, tables):
    def work(k):
        own = Tables(spark, tables.root)
        for i in range(3):
            own.add_counts("message", spark.createDataFrame([(1, 2, "send", "b", "p", 1), (k, 2, "send", "b", None, 1)], "date int, hour int, type string, selfId string, platform string, count long"))
            Rollup(own).record(requests(spark, [(f"{k}-{i}", 10 + k, None, "m", 1, True)]))

    threads = [threading.Thread(target=work, args=(k,)) for k in (2, 3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted((r.date, r["count"]) for r in tables.read("message").collect()) == [(1, 9), (2, 3), (3, 3), (4, 3)]
    assert len(ids(tables)) == 9 and Rollup(tables).pending() == [12, 13, 14]
    assert tables.state().version >= 18


@pytest.mark.parametrize("link", [True, False])
def test_a_number_is_taken_once(spark, tables, link):
    real = tables._claim
    tables._claim = lambda draft, target: real(draft, target, link)
    state = tables.state()
    state.version = 1
    assert tables._create(state) and not tables._create(state)
    assert tables.state().version == 1 and [n for n in tables._list(f"{tables.root}/_commits") if "draft" in n and not n.startswith(".")] == []


def test_one_row_costs_a_row_and_layers_are_merged(spark, tables, monkeypatch):
    first = [(f"k{i}", 10 + i % 2, "p", "m", i, True) for i in range(600)]
    tables.upsert_dated("ai_request", requests(spark, first))
    before = files(tables, "ai_request")
    want = {i: t for i, *_, t, _ in first}
    for j in range(4):
        tables.upsert_dated("ai_request", requests(spark, [(f"k{j}", 10 + j % 2, "p", "m", 1000 + j, True), (f"new{j}", 10, "p", "m", j, True)]))
        want |= {f"k{j}": 1000 + j, f"new{j}": j}
    new = set(files(tables, "ai_request")) - set(before)
    assert set(before) <= set(files(tables, "ai_request")) and sum(spark.read.parquet(f).count() for f in new) == 8
    got = lambda t=tables: {r.id: r.totalTokens for r in t.read("ai_request").collect()}
    assert got() == want
    assert got() == {r.id: r.totalTokens for d in (10, 11) for r in tables.read("ai_request").where(F.col("date") == d).collect()}
    assert tables.compact() == []
    monkeypatch.setattr(stored_tables, "LAYERS", 3)
    real = tables.write_layer

    def write(name, rows):  # a row that comes while layers are merged stays above them
        made = real(name, rows)
        tables.write_layer = real
        Tables(spark, tables.root).upsert_dated("ai_request", requests(spark, [("k0", 10, "p", "m", 77, True)]))
        return made

    tables.write_layer = write
    assert tables.compact() == ["ai_request"]
    want["k0"] = 77
    assert got() == want
    layers = tables.state().dates("ai_request")
    assert len(layers["10"]) == 2 and len(layers["11"]) == 3
    # Readers of an earlier state have its layers until they are vacuumed.
    assert tables.vacuum() == 0 and tables.vacuum(-5) == 0
    monkeypatch.setattr(stored_tables, "KEPT_COMMITS", 1)
    assert tables.vacuum(-5) > 0 and got() == want


def test_a_crash_at_each_step_leaves_all_or_nothing(spark, tables, monkeypatch):
    r = Rollup(tables)
    r.record(requests(spark, [("a", 10, None, "m", 5, True)]))
    more = requests(spark, [("a", 10, None, "m", 6, True), ("b", 11, None, "m", 7, True)])
    images = spark.createDataFrame([("i", 11)], "id string, date int")
    from botlantern import schemas
    from botlantern.plans.parse import _typed

    def work(change):
        r.add(change, more)
        change.upsert("image_generation", _typed(images, schemas.IMAGE_GENERATION))
        change.set_state("historical", {"n": 1})
        change.batch("stream", 4)

    def seen():
        s = tables.state()
        return ids(tables), tables.read("image_generation").count(), sorted(s.dirty), "historical" in s.states, s.batches

    before = seen()
    for step, name in (("write_layer", "ai_request"), ("write_layer", "image_generation"), ("_create", None), ("_claim", None)):
        real = getattr(tables, step)

        def crash(*args, real=real, name=name):
            if name is None or args[0] == name:
                raise RuntimeError("crash")
            return real(*args)

        with monkeypatch.context() as m:
            m.setattr(tables, step, crash)
            with pytest.raises(RuntimeError, match="crash"):
                tables.commit(work)
        assert seen() == before
    tables.commit(work)
    after = seen()
    assert after == (["a", "b"], 1, ["10", "11"], True, {"stream": 4})
    version = tables.state().version
    tables.commit(work)  # the same micro-batch again
    assert seen() == after and tables.state().version == version


def test_conflicts_are_told_and_tried_again(spark, tables):
    rows = spark.createDataFrame([(1, 2, "send", "b", "p", 1)], "date int, hour int, type string, selfId string, platform string, count long")

    def always(change):
        change.replace("message", rows, [1])
        Tables(spark, tables.root).upsert_dated("message", rows)

    with pytest.raises(Conflict):
        tables.commit(always, tries=2)
    tables.commit(lambda change: change.set_state("s", {"n": 1}))
    assert tables.state().states["s"]["values"] == {"n": 1}
    assert tables.read("log_import_state").count() == 0


def test_offsets_are_found_by_name(spark, tables):
    rows = spark.range(5000).select(F.concat(F.lit("2024-01-01-"), "id", F.lit(".log")).alias("fileName"), F.lit(5).alias("size").cast("long"), F.col("id").alias("lastOffset"), F.lit(0).cast("long").alias("mtimeMs"), F.current_timestamp().alias("updatedAt"))
    tables.upsert_small("log_offset", rows)
    found = LogOffsets(tables).get_many(["2024-01-01-77.log", "none"])
    assert {k: v["lastOffset"] for k, v in found.items()} == {"2024-01-01-77.log": 77}


# --- limits of a cycle --------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_budgets_end_at_lines(tmp_path, chunk):
    path = tmp_path / "a.log"
    raw = b"one\n\nthree\nfour\nlast"
    path.write_bytes(raw)
    end = lambda start, size, lines: budget_end(str(path), start, len(raw), size, lines, chunk)
    assert [end(0, 100, n) for n in (1, 2, 3, 4, 9)] == [4, 5, 11, 16, 16]
    assert [end(0, size, 9) for size in (1, 4, 5, 10, 11, 16)] == [4, 4, 5, 5, 11, 16]
    assert end(5, 2, 1) == 11 and end(16, 100, 5) == 16


def test_a_huge_file_is_read_in_bounded_batches_also_after_a_restart(spark, tables, tmp_path):
    lines, folder = random_log(3, 210), tmp_path / "logs"
    write_log(folder, lines, 300)
    config = Config(log_directory=str(folder), log_read_batch_lines=150)
    taken = []
    while True:
        live = LiveIngest(spark, tables, f"file://{tmp_path}/checkpoint", config)  # each batch by a new process
        rows = sum(p["numInputRows"] for p in live.run_once().recentProgress)
        if not rows:
            break
        taken.append(rows)
    assert taken == [150, 60]
    want = simulate(lines)
    assert stored(tables) == (unique(want[0]), unique(want[1])) and rollup_is_right(tables)


def test_known_offsets_bound_the_first_batch(tmp_path):
    (tmp_path / "2024-01-01-1.log").write_text("a\nb\nc\nd\n")
    known = {"files": {"2024-01-01-1.log": {"pos": 2, "size": 4, "mtime": 0}}}
    reader = BotLogStreamReader(str(tmp_path), {"known": json.dumps(known), "maxLinesPerFile": "2"})
    assert reader.latestOffset()["files"]["2024-01-01-1.log"]["pos"] == 6
    assert BotLogStreamReader(str(tmp_path), {"maxLinesPerFile": "2"}).latestOffset()["files"]["2024-01-01-1.log"]["pos"] == 8


def test_history_is_read_within_limits(spark, tables, tmp_path):
    lines, folder = random_log(12, 260), tmp_path / "logs"
    write_log(folder, lines, 180)
    h = HistoryImport(spark, tables, Config(log_directory=str(folder), historical_import_mode="full", log_read_batch_lines=70))
    seen = []
    for _ in range(9):
        state = HistoryImport(spark, tables, h.config).run_once()
        if state["status"] == "completed":
            break
        seen.append((state["cursorFileName"], state["processedFiles"]))
    # The batch that ends the first file goes on into the second one.
    assert seen == [(None, 0), (None, 0), ("2024-01-01-1.log", 1), ("2024-01-01-2.log", 2)]
    want = simulate(lines)
    assert stored(tables) == (unique(want[0]), unique(want[1])) and rollup_is_right(tables)


# --- the coordinator ----------------------------------------------------------------------


def test_a_cycle_runs_both_phases_once(spark, tables, tmp_path):
    lines, folder = random_log(8, 100), tmp_path / "logs"
    write_log(folder, lines, 50)
    clock, said = [1_704_200_000.0], []
    c = Coordinator(spark, tables, f"file://{tmp_path}/checkpoint", Config(log_directory=str(folder), historical_import_mode="full"), lambda: clock[0], said.append)
    real, inside = c.live.run_once, []

    def run_once():
        inside.extend([c.tick("interval"), c.tick("interval"), c.reset_history()])
        clock[0] += 300
        inside.append(c.tick("interval"))
        return real()

    c.live.run_once = run_once
    assert c.tick("ready") and inside == [False, False, "busy", False]
    assert len(said) == 2 and all("busy_skip source=interval" in s for s in said)
    want = simulate(lines)
    assert stored(tables) == (unique(want[0]), unique(want[1])) and rollup_is_right(tables)
    assert c.history.state()["processedFiles"] == 2 and c.reset_history() == "ok" and c.history.state()["processedFiles"] == 0
    c.dispose()
    assert not c.tick()


def test_a_failing_live_phase_stops_no_import(spark, tables, tmp_path):
    folder, said = tmp_path / "logs", []
    write_log(folder, random_log(8, 40), 50)
    c = Coordinator(spark, tables, f"file://{tmp_path}/checkpoint", Config(log_directory=str(folder), historical_import_mode="full"), warn=said.append)
    c.live.run_once = lambda: (_ for _ in ()).throw(OSError("disk"))
    assert c.tick() and c.history.state()["processedFiles"] == 1 and said == ["ingest failed phase=live error=disk"]


def test_a_batch_that_is_cancelled_leaves_nothing(spark, tables, tmp_path):
    lines, folder = random_log(8, 100), tmp_path / "logs"
    write_log(folder, lines, 50)
    h = HistoryImport(spark, tables, Config(log_directory=str(folder), historical_import_mode="full"))
    real = tables.write_layer

    def write(name, rows):
        threading.Timer(2, h.cancel).start()
        spark.range(1).mapInPandas(lambda batches: (__import__("time").sleep(60) or b for b in batches), "id long").collect()
        return real(name, rows)

    tables.write_layer = write
    start = time.monotonic()
    state = h.run_once()
    assert time.monotonic() - start < 50
    assert (state["status"], state["processedFiles"], state["consecutiveFailures"]) == ("running", 0, 0) and tables.read("ai_request").count() == 0
    # One that comes between jobs ends the batch before its commit.
    tables.write_layer = lambda name, rows: h.cancel() or real(name, rows)
    assert h.run_once()["processedFiles"] == 0 and tables.read("ai_request").count() == 0
    tables.write_layer = real
    assert h.run_once()["processedFiles"] == 2
    want = simulate(lines)
    assert stored(tables) == (unique(want[0]), unique(want[1]))


def test_two_importers_share_the_work(spark, tables, tmp_path):
    lines, folder = random_log(2, 120), tmp_path / "logs"
    write_log(folder, lines, 40)
    config = Config(log_directory=str(folder), historical_import_mode="full", max_historical_files_per_batch=1)
    a, b = (HistoryImport(spark, Tables(spark, tables.root), config) for _ in range(2))
    real, calls = a.tables.write_layer, []

    def write(name, rows):
        if not calls:
            calls.append(b.run_once()["processedFiles"])
        return real(name, rows)

    a.tables.write_layer = write
    assert a.run_once()["processedFiles"] == 1 and calls == [1]
    for _ in range(4):
        state = random.choice([a, b]).run_once()
    assert (state["status"], state["processedFiles"]) == ("completed", 3)
    want = simulate(lines)
    assert stored(tables) == (unique(want[0]), unique(want[1])) and rollup_is_right(tables)


# --- flushes ------------------------------------------------------------------------------


def test_flushes_by_interval_by_the_hour_and_on_demand(spark, tables, tmp_path):
    clock = [3600.0 * 100]
    facts = lambda df: df.groupBy("type").agg(F.count("*").alias("count")).selectExpr("1 as date", "2 as hour", "type", "'b' as selfId", "'p' as platform", "count")
    rows = lambda n: spark.range(n).selectExpr("'send' as type")
    flush = CountFlush(tables, "message", facts, "checkpoint", 600_000, lambda: clock[0])
    kept = lambda: sum(r["count"] for r in tables.read("message").collect())
    whole = lambda: sum(r["count"] for r in flushed_counts(tables, "message").collect())
    flush.write(rows(3), 0)
    clock[0] += 600
    flush.write(rows(4), 1)
    assert (kept(), whole()) == (0, 7) and flush.waiting().count() == 1
    clock[0] += 1
    flush.write(rows(1), 2)
    assert (kept(), whole()) == (8, 8)  # by the interval
    flush.write(rows(1), 2)  # a batch that is repeated
    clock[0] += 60
    flush.write(rows(2), 3)
    assert (kept(), whole()) == (8, 10) and flush.flush() == [3] and kept() == 10 and flush.flush() == []  # on demand
    clock[0] = 3600.0 * 101 - 1
    flush.flush()
    flush.write(rows(5), 4)
    assert (kept(), whole()) == (10, 15)
    clock[0] += 2
    flush.write(rows(6), 5)
    assert (kept(), whole()) == (21, 21)  # the hour has changed
    # A new process goes on; a flush that was cut off after its commit is not repeated.
    flush.write(rows(7), 6)
    again = CountFlush(tables, "message", facts, "checkpoint", 600_000, lambda: clock[0])
    real, tables.remove = tables.remove, lambda path: None
    assert again.flush() == [6]
    tables.remove = real
    assert again.flush() == [] and kept() == whole() == 28
