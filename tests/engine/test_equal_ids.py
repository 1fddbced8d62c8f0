"""Records that share an id but come from other lines: all are kept, and a line that is read again counts once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from botlantern.config import Config
from botlantern.operators.ai import model_daily
from botlantern.plans import catalog
from botlantern.plans.parse import parse_logs
from botlantern.sources.tables import Tables
from botlantern.streaming.ingest import HistoryImport, LiveIngest

from .test_ingest import write_log
from .test_logs import FINISH, SCHEMA, T0, line
from .test_queries import SF, rows

START = "🚀 [请求开始]"
CHAT = "[聊天模型] [a]"
#: Two calls of one millisecond, one that fails in the same, and the first one again.
CALLS = [line(CHAT, START, T0), line(CHAT, FINISH, T0 + 1), line(CHAT, START, T0), line(CHAT, FINISH.replace("100", "300"), T0 + 1), line(CHAT, START, T0), line(CHAT, "OUTPUT_EMPTY_CONTENT", T0 + 1), line(CHAT, START, T0), line(CHAT, FINISH, T0 + 1)]


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/tables")


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Events four times, with other ids and users."""
    folder = tmp_path_factory.mktemp("repeated")
    duckdb.connect().execute(f"copy (select event_id + i * 1000000 as event_id, ts, user_id + i % 2 * 3000 as user_id, event_type, value, props from '{SF}/events.parquet', range(4) t(i)) to '{folder}/events.parquet'")
    return str(folder)


def equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    assert want["id"].duplicated().any()
    assert rows(catalog.queries()[name](spark, folder).toPandas()) == rows(want)


def four_calls(tables):
    found = tables.read("ai_request")
    assert sorted((r.promptTokens, r.success) for r in found.collect()) == [(0, False), (100, True), (100, True), (300, True)]
    assert [r.id for r in found.select("id").distinct().collect()] == [f"yes-{T0}-a-{len(START) + 1}"]
    daily = lambda df: sorted(map(tuple, df.select("date", "modelId", "requestCount", "failCount", "totalTokens").collect()))
    assert daily(tables.read("ai_model_daily")) == daily(model_daily(found)) and tables.read("ai_model_daily").agg(F.sum("requestCount")).first()[0] == 4
    return True


def test_an_import_keeps_calls_of_one_id(spark, tables, tmp_path):
    write_log(tmp_path / "logs", CALLS, 3)
    h = HistoryImport(spark, tables, Config(log_directory=str(tmp_path / "logs"), historical_import_mode="full", max_historical_files_per_batch=2))
    for _ in range(2):  # once more after a reset: the same lines replace their equals
        while h.run_once()["status"] == "running":
            pass
        assert h.state()["status"] == "completed" and four_calls(tables)
        h.reset()


def test_imported_requests_equal_their_sql(spark, repeated):
    equals_its_sql(spark, repeated, "t_history_import")


def test_a_stream_keeps_calls_of_one_id(spark, tables, tmp_path):
    config = Config(log_directory=str(tmp_path / "logs"))
    for end in (5, 8):
        write_log(tmp_path / "logs", CALLS[:end], 3)
        LiveIngest(spark, tables, f"file://{tmp_path}/checkpoint", config).run_once()
    assert four_calls(tables)
    # A new stream reads all lines again.
    LiveIngest(spark, tables, f"file://{tmp_path}/another", config).run_once()
    assert four_calls(tables)


def test_streamed_requests_equal_their_sql(spark, repeated):
    equals_its_sql(spark, repeated, "t_live_ingest")


def test_images_of_one_id_are_kept(spark, tables):
    image = lambda text: line("aka-ai-image-generator", text, T0)
    ask = lambda model, n: image(f"requestProviderImages 调用 {{ provider: 'p', modelId: '{model}', numImages: {n} }}")
    done = image("provider=p event=create_success")
    values = [ask("m", 2), done, ask("n", 3), done, done]
    lines = spark.createDataFrame([("s", "2024-01-01-1.log", i, v) for i, v in enumerate(values)], SCHEMA)
    for _ in range(2):
        tables.upsert_dated("image_generation", parse_logs(lines).images)
        found = tables.read("image_generation").collect()
        assert sorted((r.modelId or "", r.numImages) for r in found) == [("", 1), ("m", 2), ("n", 3)] and {r.id for r in found} == {f"img-{T0}-p-ok"}


def test_stored_images_equal_their_sql(spark, repeated):
    equals_its_sql(spark, repeated, "w9_stored_images")
