"""Stored tables, the rollup, live and historical ingestion."""

import pytest
from pyspark.sql import functions as F

from botlantern.config import Config
from botlantern.operators.ai import model_daily
from botlantern.operators.rollup import Rollup
from botlantern.sources import tables as stored_tables
from botlantern.sources.logs import Discovery, sort_key
from botlantern.sources.offsets import LogOffsets
from botlantern.sources.tables import Tables
from botlantern.streaming.ingest import HistoryImport, LiveIngest, flush_counts, flushed_counts

from .test_logs import random_log, simulate


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/tables")


def requests(spark, rows):
    full = [(i, d, 1, "yesimbot", p, m, t, ok) for i, d, p, m, t, ok in rows]
    df = spark.createDataFrame(full, "id string, date int, hour int, source string, provider string, modelId string, totalTokens long, success boolean")
    from botlantern import schemas
    from botlantern.plans.parse import _typed

    return _typed(df, schemas.AI_REQUEST)


def daily(tables):
    return sorted((r.date, r.provider, r.modelId, r.requestCount, r.successCount, r.failCount, r.totalTokens) for r in tables.read("ai_model_daily").collect())


def test_rollup_replay_stale_rows_and_rebuild(spark, tables):
    r = Rollup(tables)
    first = requests(spark, [("a", 10, None, "m", 5, True), ("b", 10, "p", "m", 7, False), ("c", 11, "p", "n", None, None)])
    for _ in range(2):
        assert r.record(first) == [10, 11]
        assert r.has_pending_dates()
        summary = r.recompute()
        assert summary.dates == [10, 11] and not summary.pending_after and not r.has_pending_dates()
        assert daily(tables) == [(10, "", "m", 1, 1, 0, 5), (10, "p", "m", 1, 0, 1, 7), (11, "p", "n", 1, 0, 1, 0)]
    r.record(requests(spark, [("b", 10, None, "m", 9, True)]))
    r.recompute()
    assert daily(tables) == [(10, "", "m", 2, 2, 0, 14), (11, "p", "n", 1, 0, 1, 0)]
    # A date whose records are gone loses its rows.
    tables.replace_dates("ai_request", tables.read("ai_request").where("date = 11").limit(0), [11])
    r.mark([11])
    r.recompute()
    assert [x[0] for x in daily(tables)] == [10]


def test_one_bad_date_stops_no_other_and_stays_pending(spark, tables, monkeypatch):
    r = Rollup(tables)
    r.record(requests(spark, [("a", 10, None, "m", 5, True), ("c", 11, "p", "n", 1, True)]))
    real = r.rebuild

    def rebuild(dates):
        if 11 in dates:
            raise RuntimeError("bad date")
        return real(dates)

    monkeypatch.setattr(r, "rebuild", rebuild)
    summary = r.recompute()
    assert (summary.dates, summary.failed_dates, summary.pending_after) == ([10], [11], [11])
    # A new process goes on where this one stopped.
    assert Rollup(tables).recompute().dates == [11] and [x[0] for x in daily(tables)] == [10, 11]


def test_markers_that_cannot_be_cleared_count_as_pending(spark, tables, monkeypatch):
    r = Rollup(tables)
    r.record(requests(spark, [("a", 10, None, "m", 5, True)]))
    monkeypatch.setattr(r, "clear", lambda dates, at: (_ for _ in ()).throw(OSError("no")))
    summary = r.recompute()
    assert summary.pending_after == [10] and summary.pending_state_unknown


def test_raw_write_failure_leaves_nothing_marked(spark, tables, monkeypatch):
    r = Rollup(tables)
    monkeypatch.setattr(tables, "write_layer", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError, match="disk"):
        r.record(requests(spark, [("a", 10, None, "m", 5, True)]))
    assert not r.has_pending_dates()


def test_counts_add_up(spark, tables):
    rows = spark.createDataFrame([(1, 2, "send", "b", "p", 3)], "date int, hour int, type string, selfId string, platform string, count long")
    tables.add_counts("message", rows)
    tables.add_counts("message", rows.union(rows.withColumn("date", F.lit(2))))
    assert sorted((r.date, r["count"]) for r in tables.read("message").collect()) == [(1, 6), (2, 3)]


def write_log(folder, lines, per_file=50):
    folder.mkdir(exist_ok=True)
    for k in range(0, len(lines), per_file):
        (folder / f"2024-01-01-{k // per_file + 1}.log").write_text("\n".join(lines[k : k + per_file]) + "\n")


def stored(tables):
    ai = sorted(((r.id, r.firstTokenLatencyMs, r.success) for r in tables.read("ai_request").collect()), key=str)
    return ai, sorted(((r.id, r.numImages, r.userId) for r in tables.read("image_generation").collect()), key=str)


def unique(rows):
    return sorted({r[0]: r for r in rows}.values(), key=str)


def test_live_stream_equals_a_sequential_parser(spark, tables, tmp_path):
    lines = random_log(7, 120)
    folder = tmp_path / "logs"
    write_log(folder, lines[:60], 30)
    config = Config(log_directory=str(folder))
    live = LiveIngest(spark, tables, f"file://{tmp_path}/checkpoint", config)
    live.run_once()
    want = simulate(lines[:60])
    assert stored(tables) == (unique(want[0]), unique(want[1]))
    # State is kept over a restart, and only what is new is read.
    write_log(folder, lines, 30)
    again = LiveIngest(spark, tables, f"file://{tmp_path}/checkpoint", config)
    query = again.run_once()
    assert sum(p["numInputRows"] for p in query.recentProgress) <= 60
    want = simulate(lines)
    assert stored(tables) == (unique(want[0]), unique(want[1]))
    rows = lambda df: sorted(map(tuple, df.select("date", "source", "provider", "modelId", "requestCount", "totalTokens").collect()))
    assert rows(tables.read("ai_model_daily")) == rows(model_daily(tables.read("ai_request")))
    assert not again.busy() and not again.rollup.has_pending_dates()


def test_history_goes_through_its_states(spark, tables, tmp_path):
    folder = tmp_path / "logs"
    write_log(folder, random_log(9, 120), 40)
    clock = [1_704_200_000.0]
    config = Config(log_directory=str(folder), historical_import_mode="full", max_historical_files_per_batch=2)
    h = HistoryImport(spark, tables, config, lambda: clock[0])
    assert h.state()["status"] == "idle"
    first = h.run_once()
    assert (first["status"], first["cursorFileName"], first["processedFiles"]) == ("running", "2024-01-01-2.log", 2)
    second = HistoryImport(spark, tables, config, lambda: clock[0]).run_once()
    assert (second["cursorFileName"], second["processedFiles"]) == ("2024-01-01-3.log", 3) and second["importedAiRecords"] > 0
    assert h.run_once()["status"] == "completed" and h.run_once()["processedFiles"] == 3
    assert h.reset() == "ok" and h.state()["status"] == "idle" and h.state()["processedFiles"] == 0
    h.running = True
    assert h.reset() == "busy"


def test_history_does_not_depend_on_batches(spark, tmp_path):
    folder, found = tmp_path / "logs", []
    write_log(folder, random_log(9, 120), 40)
    for size in (1, 500):
        own = Tables(spark, f"file://{tmp_path}/tables{size}")
        h = HistoryImport(spark, own, Config(log_directory=str(folder), historical_import_mode="full", max_historical_files_per_batch=size))
        for _ in range(9):
            if h.run_once()["status"] == "completed":
                break
        assert h.state()["status"] == "completed" and h.state()["processedFiles"] == 3
        found.append([sorted(map(str, own.read(n).collect())) for n in ("ai_request", "image_generation")])
    assert found[0] == found[1] and all(found[0])
    want = simulate(random_log(9, 120))
    assert stored(own) == (unique(want[0]), unique(want[1]))


def test_history_stops_at_the_first_file_without_an_end(spark, tables, tmp_path):
    lines, folder = random_log(5, 90), tmp_path / "logs"
    write_log(folder, lines, 30)
    half = folder / "2024-01-01-2.log"
    whole = half.read_bytes()
    cut = len(whole) // 2
    half.write_bytes(whole[:cut])
    h = HistoryImport(spark, tables, Config(log_directory=str(folder), historical_import_mode="full"))
    first = h.run_once()
    read = whole[:cut].rfind(b"\n") + 1
    assert (first["status"], first["cursorFileName"], first["processedFiles"]) == ("running", "2024-01-01-1.log", 1)
    offset = LogOffsets(tables).get(half.name)
    assert (offset["lastOffset"], offset["size"]) == (read, cut) and LogOffsets(tables).get("2024-01-01-1.log") is None
    # Nothing new: nothing changes.
    assert h.run_once()["processedBytes"] == first["processedBytes"]
    half.write_bytes(whole)
    state = HistoryImport(spark, tables, h.config).run_once()
    assert (state["cursorFileName"], state["processedFiles"]) == ("2024-01-01-3.log", 3)
    assert state["processedBytes"] == sum(f.stat().st_size for f in folder.iterdir()) and h.run_once()["status"] == "completed"
    want = simulate(lines)
    assert stored(tables) == (unique(want[0]), unique(want[1]))


def test_a_pass_over_the_directory_goes_on_where_its_time_ran_out(spark, tables, tmp_path):
    names = [f"2024-01-{d:02}-{i}.log" for i in range(9, 0, -1) for d in range(1, 29)]
    for n in names:
        (tmp_path / n).write_text("x\n")
    ticks = iter(range(10**6))
    for newest in (False, True):
        scan = Discovery(str(tmp_path), 5, after="2024-01-02-3.log", newest=newest, names=lambda _: names)
        scan.STEP = 50
        tries = 0
        while (found := scan.advance(2, lambda: next(ticks))) is None:
            tries += 1
        order = sorted(names, key=sort_key)
        later = order[order.index("2024-01-02-3.log") + 1 :]
        assert tries and [f.name for f in found] == (later[-5:] if newest else later[:5])
    h = HistoryImport(spark, tables, Config(log_directory=str(tmp_path), historical_import_mode="full", max_historical_files_per_batch=9))
    h._files, real = lambda cursor: None, h._files
    assert h.run_once()["status"] == "running" and h.run_once()["cursorFileName"] is None
    h._files = real
    assert h.run_once()["processedFiles"] == 9


def test_offsets_of_files(spark, tables):
    offsets = LogOffsets(tables)
    assert offsets.get("a") is None and offsets.get_many([]) == {}
    old = spark.createDataFrame([("a", 5, 3), ("b", 7, 7)], "fileName string, size long, lastOffset long").withColumn("updatedAt", F.current_timestamp())
    tables.replace_small("log_offset_v2", old)
    offsets.update("a", 9, 9, 1)
    offsets.update("c", 1, 1, 2)
    offsets.update("c", 4, 2, 3)
    got = {k: (v["size"], v["lastOffset"], v["mtimeMs"]) for k, v in offsets.get_many(["a", "b", "c", "d"]).items()}
    assert got == {"a": (9, 9, 1), "b": (7, 7, 0), "c": (4, 2, 3)}


def test_a_busy_date_is_written_by_several_tasks(spark, tables, monkeypatch):
    monkeypatch.setattr(stored_tables, "FILE_ROWS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = Rollup(tables)
    r.record(requests(spark, [(f"a{i}", 10, "p", "m", 1, True) for i in range(1000)] + [("b", 11, "p", "m", 1, True)]))
    assert tables.read("ai_request").where("date = 10").select(F.input_file_name()).distinct().count() > 1
    assert tables.read("ai_request").count() == 1001
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_live_query_at_a_time(spark, tables, tmp_path):
    (tmp_path / "logs").mkdir()
    live = LiveIngest(spark, tables, f"file://{tmp_path}/checkpoint", Config(log_directory=str(tmp_path / "logs")))
    query = live.start()
    try:
        assert live.busy() and live.run_once() is query and live.start() is query
    finally:
        live.stop()
    assert not live.busy()


def test_history_waits_after_failures(spark, tables, tmp_path):
    clock = [1_704_200_000.0]
    config = Config(log_directory=str(tmp_path / "none"), historical_import_mode="recent")
    h = HistoryImport(spark, tables, config, lambda: clock[0])
    waits = []
    for _ in range(5):
        state = h.run_once()
        assert state["status"] == "failed"
        waits.append(round((state["nextRetryAt"] - state["failedAt"]).total_seconds()))
        assert h.run_once()["consecutiveFailures"] == state["consecutiveFailures"]
        clock[0] += waits[-1]
    assert waits == [60, 300, 900, 3600, 3600]
    (tmp_path / "none").mkdir()
    assert h.run_once()["status"] == "completed"
    off = HistoryImport(spark, tables, Config(historical_import_mode="disabled"))
    assert off.run_once()["status"] == "completed"


def test_recent_history_takes_the_first_day_whole(spark, tables, tmp_path):
    h = HistoryImport(spark, tables, Config(log_directory=str(tmp_path), historical_import_days=1), lambda: 1_704_200_000.0)
    from botlantern.sources.logs import discover_after

    for n in ("2024-01-01-0.log", "2024-01-01-5.log", "2023-12-31-7.log"):
        (tmp_path / n).write_text("x\n")
    assert [f.name for f in discover_after(str(tmp_path), h.first_cursor(), 9)] == ["2024-01-01-0.log", "2024-01-01-5.log"]


def test_flushed_counts(spark, tables, tmp_path):
    rows = spark.range(20).selectExpr("id as n", "'send' as type")
    rows.write.parquet(f"file://{tmp_path}/events")
    events = spark.readStream.schema("n long, type string").parquet(f"file://{tmp_path}/events")

    def facts(df):
        return df.groupBy("type").agg(F.count("*").alias("count")).selectExpr("1 as date", "2 as hour", "type", "'b' as selfId", "'p' as platform", "count")

    for _ in range(2):
        flush_counts(events, tables, "message", facts, f"file://{tmp_path}/flush", once=True).awaitTermination()
        assert [r["count"] for r in flushed_counts(tables, "message").collect()] == [20]


def test_config_bounds():
    assert Config(recent_day_count=30).default_period == 30 and Config(recent_day_count=12).default_period == 90
    for bad in ({"recent_day_count": 0}, {"log_watch_interval_ms": 10}, {"historical_import_mode": "x"}, {"max_recent_files": 2000}):
        with pytest.raises(ValueError):
            Config(**bad)
