import json

from botlantern.config import Config
from botlantern.operators import ai, dashboard, payload
from botlantern.plans import catalog, views
from botlantern.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_payload_is_one_row_with_all_figures(spark):
    inputs = catalog._inputs(spark, SF)
    small = payload.Inputs(*[df.persist() for df in vars(inputs).values()])
    names = payload.figures(small, catalog.AS_OF, Config()).keys()
    assert {"cards", "dau_history", "message_by_date", "command_rate_7", "model_share_90", "style_rank_30"} <= set(names)
    row = json.loads(payload.period_figures(small, catalog.AS_OF, 30)["ai_overview"].toJSON().first())
    assert row["total_requests"] > 0
    one = payload._folded(dashboard.message_by_hour(small.messages, catalog.AS_OF, 7), "hours").first()
    assert [h.hour for h in one.hours] == list(range(24))
    spark.catalog.clearCache()


def test_a_stored_payload_is_made_once_for_a_state_of_the_tables(spark, tmp_path, monkeypatch):
    made = []

    def folded(t, as_of, config):
        made.append(as_of)
        return spark.createDataFrame([(as_of, len(made))], "day int, n int")

    monkeypatch.setattr(payload, "payload", folded)
    tables = Tables(spark, f"file://{tmp_path}/tables")
    get = lambda day, config=None: tuple(payload.stored_payload(tables, None, day, config).first())
    assert [get(5), get(5), get(6), get(6)] == [(5, 1), (5, 1), (6, 2), (6, 2)]
    tables.commit(lambda change: change.mark([5]))
    assert get(6) == (6, 3) and get(6, Config(recent_day_count=7)) == (6, 4) and get(6) == (6, 3)
    assert len(tables._list(f"{tables.root}/_payload")) == 2


def test_empty_tables_give_zeros(spark):
    none = payload.Inputs(*[df.limit(0) for df in vars(catalog._inputs(spark, SF)).values()])
    card = payload.cards(none, catalog.AS_OF, Config()).first()
    assert (card.user_count, card.total_requests, card.success_rate, card.recent_dau, card.total_images) == (0, 0, 0.0, 0.0, 0)
    assert ai.model_share(none.ai_daily, catalog.AS_OF, 7).count() == 0
    assert dashboard.message_by_date(none.messages, catalog.AS_OF, 5).count() == 5
    assert dashboard.message_by_date(none.messages, catalog.AS_OF, 5, dense=False).count() == 0


def test_views(spark):
    rank = spark.createDataFrame([(1, 5, None, 3), (2, 6, "ann", 2)], "rank int, user_id long, user_name string, count long")
    assert [tuple(r) for r in views.user_bars(rank).collect()] == [("ann", 2), ("用户 5", 3)]
    hours = spark.createDataFrame([(0, 1.234, 0.0), (1, 2.0, 0.0)], "hour int, send double, receive double")
    assert [tuple(r) for r in views.hour_bars(hours, "send").collect()] == [(0.5, 1.23), (1.5, 2.0)]
    share = spark.createDataFrame([("m", "", 1, 5, 0.5), ("n", "p", 1, 9, 0.5)], "model_id string, provider string, request_count long, token_count long, percentage double")
    assert [tuple(r) for r in views.model_pie(share).collect()] == [("p/n", 9), ("m", 5)]
    trend = spark.createDataFrame([("2024-01-01", 1, 2, 3)], "date string, prompt_tokens long, completion_tokens long, total_tokens long")
    assert [tuple(r) for r in views.token_lines(trend).collect()] == [("2024-01-01", "completion", 2), ("2024-01-01", "prompt", 1)]
    overview = spark.createDataFrame([(3, 10, 2 / 3, 1234.5)], "total_requests long, total_tokens long, success_rate double, avg_latency_ms double")
    assert tuple(views.number_cards(overview).first()) == (3, 10, 66.7, 1.23)


def test_unresolved_names_and_user_zero(spark):
    commands = spark.createDataFrame([(9, 1, "a", 0, 5), (9, 1, "b", 3, 2), (9, 1, "a", 3, 2), (9, 2, "a", 4, 1), (10, 2, "a", 4, 9)], "date int, hour int, name string, userId long, count long")
    profiles = spark.createDataFrame([(3, "")], "userId long, userName string")
    users = spark.createDataFrame([(3, "host"), (5, "x")], "id long, name string")
    got = dashboard.user_usage_rank(commands, profiles, users, 10, 7).orderBy("rank").collect()
    assert [(r["rank"], r.user_id, r.user_name, r["count"], r.top_command) for r in got] == [(1, 3, "host", 4, "a"), (2, 4, None, 1, "a")]
