"""The live phase: what batches leave open, its plan, and crashes between its steps."""

import pytest

from botlantern.config import Config
from botlantern.plans.parse import CARRIED, classified, events_of, known_of, open_lines, records_of
from botlantern.sources.tables import Tables
from botlantern.streaming.ingest import OPEN, LiveIngest

from .test_ingest import stored, unique, write_log
from .test_logs import FINISH, SCHEMA, T0, line, random_log, simulate

START, USAGE = "🚀 [请求开始]", "Token usage from API: input=1 output=2 total=3"
COMMAND = "记录指令调用 | 用户: u7 | 指令: c | 频道: qq:1"
MINUTE = 60_000


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/tables")


def known(spark, values, file="2024-01-01-1.log", at=0):
    rows = [("s", file, at + i, v) for i, v in enumerate(values)]
    return known_of(classified(events_of(spark.createDataFrame(rows, SCHEMA)), Config()))


def open_rows(spark, tables):
    (left,) = [s["values"] for key, s in tables.state().states.items() if key.startswith("live ")]
    return spark.read.schema(OPEN).parquet(left["path"]).collect()


def test_what_is_open_stays_small_and_contexts_expire(spark):
    values, ts = [], T0
    for i in range(200):
        ts += 1000
        values += [line("[聊天模型] [a]", START, ts), line("[聊天模型] [a]", "🌊 流式传输已开始 | 延迟: 5ms", ts), line("chatluna", f"model: m{i}", ts), line("[世界状态]", COMMAND, ts), line("aka-ai-image-generator", "requestProviderImages 调用 provider: 'x', numImages: 2 }", ts)]
    left = open_lines(known(spark, values)).collect()
    assert len(left) == 5 and all(r.offset == len(values) - 5 + i - CARRIED for i, r in enumerate(sorted(left, key=lambda r: r.offset)))
    # Later lines of another model: first the command is too old, then the mention, too.
    for minutes, names in ((1, 5), (2, 4), (4, 4), (5, 3)):
        later = known(spark, [*values, line("[聊天模型] [b]", START, ts + minutes * MINUTE), line("[聊天模型] [b]", FINISH, ts + minutes * MINUTE)])
        assert open_lines(later).count() == names
    # What is carried on again keeps its place, and a call that ends is no longer open.
    again = spark.createDataFrame([("s", r.file, r.offset, r.value) for r in left], SCHEMA)
    events = known_of(classified(events_of(again), Config()))
    assert sorted(open_lines(events).collect()) == sorted(left)
    assert open_lines(events.unionByName(known(spark, [line("[聊天模型] [a]", FINISH, ts)]))).count() == 3
    assert open_lines(known(spark, [])).count() == 0


def test_a_line_of_another_stream_ends_nothing(spark):
    one = known(spark, [line("[聊天模型] [a]", START, T0), line("chatluna", "model: m", T0)])
    rows = spark.createDataFrame([("other", "2024-01-02-1.log", 0, line("[聊天模型] [a]", FINISH, T0 + 60 * MINUTE))], SCHEMA)
    assert open_lines(one.unionByName(known_of(classified(events_of(rows), Config())))).count() == 2


def test_records_need_no_python_and_no_task_for_a_whole_directory(spark):
    events = known(spark, [line("chatluna", USAGE, T0)])
    for df in records_of(events, Config()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan
        # Windows over lines are dealt by file; only those over one row for each file and key are not.
        lines = [part for part in plan.split("\n") if " Window " in part and "offset#" in part]
        assert lines and all("file_key" in part.split("windowspecdefinition(")[1].split(" ASC")[0] for part in lines)


def test_many_small_batches_equal_a_sequential_parser(spark, tables, tmp_path):
    lines, folder = random_log(17, 160), tmp_path / "logs"
    live = LiveIngest(spark, tables, f"file://{tmp_path}/checkpoint", Config(log_directory=str(folder)))
    for end in (13, 40, 41, 90, 160):
        write_log(folder, lines[:end], 60)
        query = live.run_once()
        assert query.lastProgress["stateOperators"] == [] and len(open_rows(spark, tables)) <= 8  # two models, two providers, two contexts
        want = simulate(lines[:end])
        assert stored(tables) == (unique(want[0]), unique(want[1]))
    assert len(tables._list(tables.path("log_live_open"))) == 1


def test_a_file_that_is_written_anew_ends_what_the_old_one_began(spark, tables, tmp_path):
    folder = tmp_path / "logs"
    live = LiveIngest(spark, tables, f"file://{tmp_path}/checkpoint", Config(log_directory=str(folder)))
    write_log(folder, ["junk" * 50, line("[聊天模型] [a]", START, T0), line("chatluna", "model: m", T0), line("[世界状态]", COMMAND, T0)])
    live.run_once()
    write_log(folder, [line("[聊天模型] [a]", FINISH, T0 + 9), line("chatluna", USAGE, T0 + 9)])
    live.run_once()
    ai, _ = stored(tables)
    assert [r[0] for r in ai] == [f"cl-{T0 + 9}-m-1-2", f"yes-{T0}-a-{len(START) + 1}"]


def test_a_crash_at_each_step_of_a_micro_batch_loses_and_repeats_nothing(spark, tables, tmp_path, monkeypatch):
    lines, folder = random_log(23, 120), tmp_path / "logs"
    config, checkpoint = Config(log_directory=str(folder)), f"file://{tmp_path}/checkpoint"
    write_log(folder, lines[:60], 30)
    LiveIngest(spark, tables, checkpoint, config).run_once()
    write_log(folder, lines, 30)
    first = stored(tables)
    broken = lambda *a, **k: (_ for _ in ()).throw(OSError("crash"))
    # Before the commit: nothing is there. After it, before the rollup: all is there once.
    for step, whole in (("_create", False), ("compact", True)):
        live = LiveIngest(spark, Tables(spark, tables.root), checkpoint, config)
        monkeypatch.setattr(live.tables, step, broken)
        with pytest.raises(Exception, match="crash"):
            live.run_once()
        assert (stored(tables) == first) is not whole
    LiveIngest(spark, tables, checkpoint, config).run_once()
    want = simulate(lines)
    assert stored(tables) == (unique(want[0]), unique(want[1]))
    # The folder that the crash left is named by no state.
    assert len(tables._list(tables.path("log_live_open"))) == 2
    tables.vacuum(older_than_s=-1)
    assert len(tables._list(tables.path("log_live_open"))) == 1 and len(open_rows(spark, tables)) <= 8
    assert stored(tables) == (unique(want[0]), unique(want[1]))


def test_a_drained_directory_equals_a_sequential_parser(spark, tables, tmp_path):
    # More files than are followed at once, each of more lines than a batch takes of it; the first ones say nothing.
    lines, folder = random_log(29, 130), tmp_path / "logs"
    write_log(folder, lines, 60)
    for k in (1, 2, 3):
        (folder / f"2023-12-31-{k}.log").write_text("\n")
    live = LiveIngest(spark, tables, f"file://{tmp_path}/checkpoint", Config(log_directory=str(folder), max_recent_files=2, log_read_batch_lines=50))
    assert live.drain() == 5
    want = simulate(lines)
    assert stored(tables) == (unique(want[0]), unique(want[1]))
    assert live.drain() == 0
