import json
import os

from conftest import SF_SMALL, rows
from quayside.operators.encode import event_messages
from quayside.plans import standins as si
from quayside.schemas import EVENT_MESSAGE_DDL
from quayside.session import scratch_dir
from quayside.streaming.events import events_to_json_files, file_messages, run_available


def test_json_sink_replay_adds_nothing_and_keeps_nulls(spark):
    src, out, ck, rej = (scratch_dir(spark, n) for n in ("s-src", "s-out", "s-ck", "s-rej"))
    event_messages(si.app_events(spark, SF_SMALL)).repartition(2).write.text(src)
    with open(os.path.join(src, "zz-bad.txt"), "w") as f:
        f.write('{"event_id": "seven", "user_id": 1}\n')
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    for _ in range(2):
        q, qq = events_to_json_files(file_messages(spark, src), out, ck, trigger={"availableNow": True},
                                     quarantine_path=rej)
        run_available(q)
        run_available(qq)
    back = spark.read.schema(EVENT_MESSAGE_DDL).json(out)
    assert back.count() == n and back.select("event_id").distinct().count() == n
    assert spark.read.parquet(rej).count() == 1
    raw = spark.read.text(out).filter("value like '%\"payload\":null%'").count()
    assert raw == back.filter("payload is null").count() > 0


def test_messages_parse_back(spark):
    m = event_messages(si.app_events(spark, SF_SMALL)).first().value
    d = json.loads(m)
    assert set(d) == {"event_id", "user_id", "event_type", "payload", "created_at"}
    assert "T" in d["created_at"]


def test_ticker_stream_appends_and_rejects(spark):
    from quayside.operators import aggregates as agg
    from quayside.streaming.market import start_ticker_stream
    from quayside.streaming.trades import response_stream
    src, ck, root = (scratch_dir(spark, n) for n in ("t-src", "t-ck", "t-root"))
    si.ticker_responses(agg.ticker_from_trades(si.agg_trades(spark, SF_SMALL))).write.json(src)
    q = start_ticker_stream(root, response_stream(spark, src), ck, trigger={"availableNow": True})
    run_available(q)
    good = spark.read.parquet(f"{root}/ticker_24hr")
    assert good.filter("symbol = 'SIGNUP'").count() == 0 and good.count() == 4
    assert rows(spark.read.parquet(f"{root}/ticker_rejects"), "symbol", "reason") == [("SIGNUP", "empty_last_price_or_volume")]


def test_trade_stream_drops_repeated_pages_within_horizon(spark):
    from pyspark.sql import functions as F
    from quayside.operators.ingest import TradeStore
    from quayside.streaming.trades import response_stream, start_trade_stream
    src, ck = scratch_dir(spark, "d-src"), scratch_dir(spark, "d-ck")
    store = TradeStore(spark, scratch_dir(spark, "d-store"))
    pages = si.trade_pages(spark, SF_SMALL).drop("page_no")
    pages.write.json(f"{src}/a")
    pages.write.json(f"{src}/b")            # every page delivered twice
    q = start_trade_stream(store, response_stream(spark, f"{src}/*"), ck, trigger={"availableNow": True})
    run_available(q)
    m = spark.read.parquet(store.metrics_path).agg(F.sum("attempted"), F.sum("inserted")).first()
    good = store.trades().count()
    assert m[0] == m[1] == good                    # duplicates never reached the batch job
    assert good == si.agg_trades(spark, SF_SMALL).filter("agg_trade_id % 97 <> 0").count()


def test_repeated_pages_without_a_fetch_time_are_kept(spark):
    from quayside.streaming.trades import drop_repeated_pages

    df = spark.createDataFrame([("e", "A", 200, "x", None), ("e", "A", 200, "x", None), ("e", "B", 200, "y", None), ("e", "B", 200, "y", 5)],
                               "endpoint string, symbol string, status int, body string, fetched_at long")
    assert sorted(tuple(r) for r in drop_repeated_pages(df).collect()) == [("e", "A", 200, "x", None), ("e", "B", 200, "y", 5)]


def _page(spark, path, trades, symbol="A", at="2024-01-01 00:00:00", body=None):
    import json as j
    body = body or j.dumps([{"a": i, "p": p, "q": "1", "f": i, "l": i, "T": 1000 + i, "m": True, "M": True} for i, p in trades])
    spark.createDataFrame([("aggTrades", symbol, 200, body, at)], "endpoint string, symbol string, status int, body string, fetched_at string") \
        .selectExpr("endpoint", "symbol", "CAST(NULL AS INT) AS depth", "status", "body", "CAST(fetched_at AS TIMESTAMP_NTZ) AS fetched_at") \
        .write.json(path)


def _seen_run(spark, store, src, ck):
    from quayside.streaming.trades import response_stream, start_deduplicated_trade_stream, state_report
    q = start_deduplicated_trade_stream(store, response_stream(spark, f"{src}/*"), ck, trigger={"availableNow": True})
    run_available(q)
    return state_report(q)


def test_state_drops_overlapping_polls_across_restarts(spark):
    """Overlapping pages, a restart, a bad element and a bad page that come again, and a lost checkpoint."""
    from quayside.operators.ingest import TradeStore
    src, ck = scratch_dir(spark, "u-src"), scratch_dir(spark, "u-ck")
    store = TradeStore(spark, scratch_dir(spark, "u-store"))
    _page(spark, f"{src}/1", [(1, "10"), (2, "20"), (3, "")])
    _page(spark, f"{src}/2", [(1, "10")], symbol="B")
    assert _seen_run(spark, store, src, ck)["state_rows"] == 4
    _page(spark, f"{src}/3", [(2, "20"), (3, ""), (4, "40"), (1, "11")], at="2024-01-01 00:00:05")   # a version of 1 that differs
    _page(spark, f"{src}/4", None, body="{}")
    state = _seen_run(spark, store, src, ck)
    assert state["state_rows"] == 7 and state["repeats_dropped"] == 2 and state["state_bytes"] > 0
    _page(spark, f"{src}/5", None, body="{}", at="2024-01-01 00:00:10")
    assert _seen_run(spark, store, src, ck)["repeats_dropped"] == 1
    stored = [("A", 1, 10), ("A", 2, 20), ("A", 4, 40), ("B", 1, 10)]
    assert rows(store.trades().selectExpr("symbol", "agg_trade_id", "CAST(price AS INT)")) == stored
    assert rows(store.rejects(), "reason", "item") == [("empty_price_or_quantity", "3"), ("unexpected_json_container", None)]
    assert rows(store.marks(), "symbol", "last_id") == [("A", 4), ("B", 1)]
    m = store.metrics().selectExpr("sum(attempted)", "sum(inserted)").first()
    assert tuple(m) == (5, 4)                       # only the other version of trade 1 was probed in vain
    _seen_run(spark, store, src, scratch_dir(spark, "u-ck2"))     # the state is lost: the store's keys decide
    assert rows(store.trades().selectExpr("symbol", "agg_trade_id", "CAST(price AS INT)")) == stored


def test_versions_of_a_trade_new_in_one_batch_are_settled_alike(spark):
    """Whatever copy the state keeps and wherever the rows lie: the same version is stored."""
    from quayside.operators.ingest import TradeStore
    got = set()
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        src, ck = scratch_dir(spark, "v-src"), scratch_dir(spark, "v-ck")
        store = TradeStore(spark, scratch_dir(spark, "v-store"))
        for n, k in enumerate(order):
            _page(spark, f"{src}/{n}", [(1, ["10", "11", "10"][k])], at=f"2024-01-01 00:00:0{k}")
        assert _seen_run(spark, store, src, ck)["state_rows"] == 2
        got.add(store.trades().selectExpr("CAST(price AS INT)").first()[0])
    assert len(got) == 1
