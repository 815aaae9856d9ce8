import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows
from quayside.operators.decode import (book_sizes, cut_levels, decode_agg_trades, decode_events, decode_order_book, decode_symbols,
                                        decode_ticker)
from quayside.schemas import RESPONSE_DDL


def responses(spark, items):
    """items: (endpoint, symbol, depth, body)."""
    data = [(e, s, d, 200, None, None, b, dt.datetime(2024, 1, 1, 0, 0, i)) for i, (e, s, d, b) in enumerate(items)]
    return spark.createDataFrame(data, RESPONSE_DDL)


def trade(a, p="1.50", q="2", f=1, l=2, T=1704067200123, m=True, M=False, **extra):
    d = {"a": a, "p": p, "q": q, "f": f, "l": l, "T": T, "m": m, "M": M}
    d.update(extra)
    return d


def test_trades_keep_m_and_M_apart_and_use_request_symbol(spark):
    body = json.dumps([trade(1, m=True, M=False), trade(2, m=False, M=True)])
    good = decode_agg_trades(responses(spark, [("aggTrades", "BTCUSDT", None, body)])).good
    got = rows(good, "symbol", "agg_trade_id", "is_buyer_maker", "is_best_match", "price", "trade_time")
    assert got == [("BTCUSDT", 1, True, False, Decimal("1.50000000"), dt.datetime(2024, 1, 1, 0, 0, 0, 123000)),
                   ("BTCUSDT", 2, False, True, Decimal("1.50000000"), dt.datetime(2024, 1, 1, 0, 0, 0, 123000))]


def test_trades_missing_fields_are_zero_values(spark):
    body = json.dumps([{"a": 5, "p": "1", "q": "1"}])
    g = decode_agg_trades(responses(spark, [("aggTrades", "X", None, body)])).good.first()
    assert (g.first_trade_id, g.last_trade_id, g.is_buyer_maker, g.is_best_match) == (0, 0, False, False)
    assert g.trade_time == dt.datetime(1970, 1, 1)


def test_trades_empty_price_dropped_bad_decimal_quarantined(spark):
    body = json.dumps([trade(1, p=""), trade(2, q=None), trade(3, p="abc"), trade(4, p="0.1234567890123456789"), trade(5)])
    d = decode_agg_trades(responses(spark, [("aggTrades", "X", None, body)]))
    assert rows(d.good, "agg_trade_id") == [(5,)]
    assert rows(d.rejects, "item", "reason") == [("1", "empty_price_or_quantity"), ("2", "empty_price_or_quantity"),
                                                 ("3", "bad_decimal"), ("4", "bad_decimal")]


def test_whole_body_rejected_on_type_mismatch_or_bad_json(spark):
    bad_type = json.dumps([trade(1), {"a": "2", "p": "1", "q": "1"}])       # id as text
    fraction = json.dumps([trade(1), {"a": 2.5, "p": "1", "q": "1"}])        # id not whole
    price_num = json.dumps([{"a": 1, "p": 1.5, "q": "1"}])                   # price as number
    obj = json.dumps(trade(1))                                              # object, array expected
    trunc = json.dumps([trade(1)])[:-3]
    html = "<html><body>oops</body></html>"
    ok = json.dumps([trade(9)])
    d = decode_agg_trades(responses(spark, [("aggTrades", s, None, b) for s, b in [
        ("T1", bad_type), ("T2", fraction), ("T3", price_num), ("T4", obj), ("T5", trunc), ("T6", html),
        ("T7", ok), ("T8", "  ")]]))
    assert rows(d.good, "symbol", "agg_trade_id") == [("T7", 9)]
    assert rows(d.rejects, "symbol", "reason") == [
        ("T1", "json_type_mismatch"), ("T2", "json_type_mismatch"), ("T3", "json_type_mismatch"),
        ("T4", "unexpected_json_container"), ("T5", "malformed_json"), ("T6", "unexpected_json_container"),
        ("T8", "empty_body")]


def test_reject_keeps_first_500_bytes(spark):
    body = "<" + "é" * 400  # 801 bytes; the cut falls inside a 2-byte character
    d = decode_agg_trades(responses(spark, [("aggTrades", "X", None, body)]))
    r = d.rejects.first()
    assert r.raw_bytes == 500 and r.raw_prefix.startswith("<éé")
    assert r.raw_text == body      # the whole body stays, so it can be decoded again


def test_book_levels_drop_compact_and_depth(spark):
    body = json.dumps({"lastUpdateId": 77,
                       "bids": [["10", "1"], ["9"], ["", "2"], ["8", "3", "extra"], ["7", "4"], ["6", "5"]],
                       "asks": []})
    b = decode_order_book(responses(spark, [("depth", "S", 3, body), ("depth", "E", 5,
                                             json.dumps({"lastUpdateId": 1, "bids": [], "asks": []}))]))
    # every usable level is stored, however deep; the cut is made when reading
    assert rows(b.levels, "side", "level_index", "price") == [
        ("bid", 0, Decimal(10)), ("bid", 1, Decimal(8)), ("bid", 2, Decimal(7)), ("bid", 3, Decimal(6))]
    assert rows(cut_levels(b.levels, 3), "level_index") == [(0,), (1,), (2,)]
    assert rows(b.rejects, "reason", "item", "raw_text") == [
        ("unusable_level", "77:bid:1", '["9"]'), ("unusable_level", "77:bid:2", '["","2"]')]
    # header kept even without levels; one header per response
    assert rows(b.headers, "symbol", "last_update_id", "depth_level") == [("E", 1, 5), ("S", 77, 3)]
    ids = {r.snapshot_id for r in b.headers.collect()}
    assert {r.snapshot_id for r in b.levels.collect()} <= ids


def test_book_wrong_level_type_rejects_body(spark):
    body = json.dumps({"lastUpdateId": 1, "bids": [["1", 2]], "asks": []})
    b = decode_order_book(responses(spark, [("depth", "S", 20, body)]))
    assert b.headers.count() == 0 and rows(b.rejects, "reason") == [("json_type_mismatch",)]


def test_symbols_empty_status_dropped(spark):
    body = json.dumps({"symbols": [
        {"symbol": "A", "status": "TRADING", "baseAsset": "a", "quoteAsset": "q", "baseAssetPrecision": 8,
         "quotePrecision": 8},
        {"symbol": "B", "status": "", "baseAsset": "b", "quoteAsset": "q"},
        {"symbol": "", "status": "TRADING"}]})
    d = decode_symbols(responses(spark, [("exchangeInfo", None, None, body)]))
    assert rows(d.good, "symbol", "status", "base_precision") == [("A", "TRADING", 8)]
    assert d.rejects.count() == 2


def _ticker_body(**over):
    nums = {k: "1.5" for k in ("priceChange", "priceChangePercent", "weightedAvgPrice", "prevClosePrice",
                               "lastPrice", "lastQty", "bidPrice", "bidQty", "askPrice", "askQty", "openPrice",
                               "highPrice", "lowPrice", "volume", "quoteVolume")}
    nums.update({"symbol": "IGNORED", "openTime": 0, "closeTime": 1000, "firstId": 1, "lastId": 9, "count": 9})
    nums.update(over)
    return json.dumps(nums)


def test_ticker_rejects_empty_last_price_and_bad_numbers(spark):
    d = decode_ticker(responses(spark, [("ticker24hr", "OK", None, _ticker_body()),
                                        ("ticker24hr", "NOLAST", None, _ticker_body(lastPrice="")),
                                        ("ticker24hr", "BADNUM", None, _ticker_body(bidQty="x"))]))
    g = d.good.collect()
    assert [r.symbol for r in g] == ["OK"] and len(d.good.columns) == 22
    assert g[0].close_time == dt.datetime(1970, 1, 1, 0, 0, 1)
    assert rows(d.rejects, "symbol", "reason") == [("BADNUM", "bad_decimal"), ("NOLAST", "empty_last_price_or_volume")]


def test_event_messages_decode_and_quarantine(spark):
    msgs = [json.dumps({"event_id": 1, "user_id": 2, "event_type": "click", "payload": None, "created_at": "x"}),
            json.dumps({"event_id": "3", "user_id": 4, "event_type": "view", "payload": "{}", "created_at": "y"}),
            json.dumps({"event_id": 7.5, "user_id": 4, "event_type": "view", "payload": "{}", "created_at": "y"}),
            "not json"]
    d = decode_events(spark.createDataFrame([(m,) for m in msgs], "value string"))
    assert rows(d.good) == [(1, 2, "click", None, "x"), (3, 4, "view", "{}", "y")]
    assert rows(d.rejects, "reason") == [("bad_number",), ("malformed_json",)]


def test_full_books_give_snapshots_times_two_times_depth_levels(spark):
    depth = 20
    side = [[f"{100 + i}.5", "1"] for i in range(25)]          # deeper than requested
    items = [("depth", f"S{k}", depth, json.dumps({"lastUpdateId": k, "bids": side, "asks": side})) for k in range(24)]
    b = decode_order_book(responses(spark, items))
    assert b.headers.count() == 24 and b.levels.count() == 24 * 2 * 25
    assert cut_levels(b.levels, depth).count() == 24 * 2 * depth   # 960, as in the recorded run


def test_prices_stay_exact_decimals(spark):
    body = json.dumps([trade(1, p="0.10000000", q="123456789.12345678"), trade(2, p="0.3", q="0.1")])
    g = decode_agg_trades(responses(spark, [("aggTrades", "X", None, body)])).good
    assert g.schema["price"].dataType.simpleString() == "decimal(38,18)"
    got = rows(g, "agg_trade_id", "price", "quantity")
    assert got == [(1, Decimal("0.10000000"), Decimal("123456789.12345678")),
                   (2, Decimal("0.30000000"), Decimal("0.10000000"))]
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert "as double" not in plan.lower() and "as float" not in plan.lower()


def test_recorded_responses_round_trip_through_files(spark):
    from quayside.plans import standins as si
    from quayside.session import scratch_dir
    from quayside.sources.responses import read_responses
    path = scratch_dir(spark, "resp-files")
    si.trade_pages(spark, "/root/testdata/sf0.001").drop("page_no").write.json(path)
    back = read_responses(spark, path)
    assert back.count() == si.trade_pages(spark, "/root/testdata/sf0.001").count()
    assert decode_agg_trades(back).good.count() == decode_agg_trades(si.trade_pages(spark, "/root/testdata/sf0.001")).good.count()


def test_wide_numbers_are_kept_and_lossy_ones_quarantined(spark):
    texts = ["12345678901.5", "1000000000000.00", "0.0000000012", "0.000000000001", "1e-18", "1E3", " 7.50 ",
             "0.100000000000000000000000", "0.1234567890123456789", "1e-19", "1" * 21, "x", "-0.5"]
    body = json.dumps([trade(i, p=t, q="1") for i, t in enumerate(texts)])
    d = decode_agg_trades(responses(spark, [("aggTrades", "X", None, body)]))
    got = dict(rows(d.good, "agg_trade_id", "price"))
    lossy = {8, 9, 10, 11}
    assert got == {i: Decimal(t.strip()) for i, t in enumerate(texts) if i not in lossy}
    assert rows(d.rejects, "item", "reason") == sorted((str(i), "bad_decimal") for i in lossy)


def test_ticker_keeps_large_volumes(spark):
    d = decode_ticker(responses(spark, [("ticker24hr", "BIG", None, _ticker_body(volume="15000000000.000000000001"))]))
    assert rows(d.good, "symbol", "volume") == [("BIG", Decimal("15000000000.000000000001"))]


def test_nested_key_of_the_same_name_does_not_count(spark):
    wrong = json.dumps({"lastUpdateId": "x", "bids": [], "asks": [], "meta": {"lastUpdateId": 5}})
    right = json.dumps({"lastUpdateId": 5, "bids": [], "asks": [], "meta": {"lastUpdateId": "x"}})
    b = decode_order_book(responses(spark, [("depth", "W", 5, wrong), ("depth", "R", 5, right)]))
    assert rows(b.headers, "symbol") == [("R",)] and rows(b.rejects, "symbol", "reason") == [("W", "json_type_mismatch")]
    page = json.dumps([dict(trade(1), more={"a": "x"}), trade(2)])
    mixed = json.dumps([trade(3), 5])
    d = decode_agg_trades(responses(spark, [("aggTrades", "G", None, page), ("aggTrades", "M", None, mixed)]))
    assert rows(d.good, "agg_trade_id") == [(1,), (2,)] and rows(d.rejects, "symbol") == [("M",)]


LONG = "x" * 21_000_000   # more than the parser takes as one string


def test_bodies_over_16_mib_decode(spark):
    """Books whose bulk is an unknown key or the levels, a long trade page, a long symbol list."""
    level = ["1.5", "2", "x" * 1000]
    pad = json.dumps({"lastUpdateId": 1, "bids": [["1", "2"]], "asks": [None], "pad": LONG})
    deep = json.dumps({"lastUpdateId": 2, "bids": [level] * 10_000, "asks": [level] * 10_000})
    got = [decode_order_book(responses(spark, [("depth", "B", 5, body)])) for body in (pad, deep)]   # one body a job: a test JVM is small
    assert [b.headers.first().last_update_id for b in got] == [1, 2] and [b.levels.count() for b in got] == [1, 20_000]
    page = json.dumps([dict(trade(i), note="y" * 1000) for i in range(18_000)])
    assert decode_agg_trades(responses(spark, [("aggTrades", "T", None, page)])).good.agg(F.count("price"), F.max("agg_trade_id")).first()[:] == (18_000, 17_999)
    sym = {"symbol": "A", "status": "TRADING", "baseAsset": "a", "quoteAsset": "q", "baseAssetPrecision": 8, "quotePrecision": 9, "filters": [1]}
    info = json.dumps({"symbols": [sym] * 100, "pad": LONG})
    assert decode_symbols(responses(spark, [("exchangeInfo", None, None, info)])).good.count() == 100


def test_faults_beside_an_overlong_string(spark):
    """The reasons are those of small bodies; only an overlong known value has a reason of its own."""
    good = {"lastUpdateId": 1, "bids": [["1", "2"]], "asks": [], "pad": LONG}
    faults = {"level": {**good, "bids": [["1", 2]]}, "list": {**good, "asks": 5}, "id": {**good, "lastUpdateId": "1"}, "element": {**good, "asks": ["1"]}}
    bodies = {k: json.dumps(v) for k, v in faults.items()} | {"cut": json.dumps(good)[:-1], "value": json.dumps({**good, "bids": [["1", LONG]], "pad": 0})}
    want = dict.fromkeys(faults, "json_type_mismatch") | {"cut": "malformed_json", "value": "body_over_parser_limit"}
    for k, body in bodies.items():
        b = decode_order_book(responses(spark, [("depth", k, 5, body)]))
        assert rows(b.rejects.select("reason", F.length("raw_text"))) == [(want[k], len(body))], k
    page = json.dumps([dict(trade(1), note=LONG), trade(2)])
    for k, body in {"cut": page[:-1], "whole": page}.items():
        d = decode_agg_trades(responses(spark, [("aggTrades", k, None, body)]))
        assert rows(d.rejects, "reason") == [("malformed_json" if k == "cut" else "body_over_parser_limit",)], k


def test_reject_keeps_the_whole_element(spark):
    d = decode_agg_trades(responses(spark, [("aggTrades", "X", None, json.dumps([trade(1, p="1e400", f=7, T=9), trade(2, q=None)]))]))
    assert [json.loads(r.raw_text) for r in d.rejects.orderBy("item").collect()] == [trade(1, p="1e400", f=7, T=9), trade(2, q=None)]
    d = decode_ticker(responses(spark, [("ticker24hr", "T", None, _ticker_body(askQty="x"))]))
    assert json.loads(d.rejects.first().raw_text) == json.loads(_ticker_body(askQty="x"))
    sym = {"symbol": "A", "status": "", "baseAsset": "a", "quoteAsset": "q", "baseAssetPrecision": 8, "quotePrecision": 9}
    big = {**sym, "status": "TRADING", "symbol": "B", "quotePrecision": 3_000_000_000}
    d = decode_symbols(responses(spark, [("exchangeInfo", None, None, json.dumps({"symbols": [sym, big]}))]))
    assert d.good.count() == 0
    assert {r.reason: json.loads(r.raw_text) for r in d.rejects.collect()} == {"empty_symbol_or_status": sym, "number_out_of_range": big}


def test_a_book_deeper_than_its_index_column(spark):
    body = json.dumps({"lastUpdateId": 1, "bids": [[str(i + 1), "1"] for i in range(33_000)], "asks": []})
    b = decode_order_book(responses(spark, [("depth", "S", 50_000, body)]))
    assert b.levels.count() == 32_768 and b.levels.agg(F.max("level_index")).first()[0] == 32_767
    assert b.rejects.count() == 33_000 - 32_768 and rows(b.rejects.select("reason").distinct()) == [("number_out_of_range",)]


def test_book_sizes_count_what_decoding_gives(spark):
    """Unusable, inexact and too deep levels, absent and null sides, an empty book, a rejected body."""
    many = [[str(i + 1), "1"] for i in range(33_000)]
    books = {"A": {"lastUpdateId": 1, "bids": [["1", "2"], ["", "2"], ["3"], None, ["x", "1"], ["1e400", "1"]], "asks": [["1", "2"], ["3", "4"]]},
             "B": {"lastUpdateId": 2, "bids": [], "asks": None}, "C": {}, "D": {"lastUpdateId": "x"}, "E": {"lastUpdateId": 5, "bids": [["y", "1"]] + many}}
    r = responses(spark, [("depth", k, 5, json.dumps(v)) for k, v in books.items()])
    d, sizes = decode_order_book(r), rows(book_sizes(r), "symbol", "bid", "ask")
    assert sizes == [("A", 1, 2), ("B", 0, 0), ("C", 0, 0), ("E", 32_767, 0)]
    n = {tuple(x)[:2]: x[2] for x in d.levels.groupBy("symbol", "side").count().collect()}
    assert sizes == [(h.symbol, n.get((h.symbol, "bid"), 0), n.get((h.symbol, "ask"), 0)) for h in d.headers.orderBy("symbol").collect()]


def test_a_poll_recorded_twice_is_two_snapshots(spark):
    from quayside.operators.decode import numbered_responses
    body = json.dumps({"lastUpdateId": 1, "bids": [["1", "1"]], "asks": [["2", "1"]]})
    twice = responses(spark, [("depth", "S", 5, body)])
    b = decode_order_book(numbered_responses(twice.unionByName(twice)))
    assert b.headers.count() == 2 and b.headers.select("snapshot_id").distinct().count() == 2
    assert b.levels.join(b.headers, "snapshot_id").count() == 4
    t = responses(spark, [("ticker24hr", "T", None, _ticker_body())])
    assert decode_ticker(numbered_responses(t.unionByName(t))).good.select("id").distinct().count() == 2


def test_responses_without_success_are_named(spark):
    rows_ = [("aggTrades", f"S{s}", None, s, None, None, "[]", None) for s in (200, 201, 503, None)]
    d = decode_agg_trades(spark.createDataFrame(rows_, RESPONSE_DDL))
    assert rows(d.rejects, "symbol", "reason", "raw_text") == [(f"S{s}", "status_not_ok", "[]") for s in (201, 503, None)]


def test_a_message_cut_short_is_no_event(spark):
    texts = ['{"event_id":3', '{"event_id":3,"user_id":4}', '{"event_id":3,"user_id":4', '[1]', '', None, '{"event_id":"x"}']
    d = decode_events(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert rows(d.good, "event_id", "user_id") == [(3, 4)]
    assert sorted((r.reason, r.raw_text or "") for r in d.rejects.collect()) == sorted(
        [("malformed_json", t or "") for t in (texts[0], texts[2], "[1]", "", None)] + [("bad_number", texts[6])])


def test_staged_books_are_parsed_once_and_equal_the_plain_ones(spark):
    bodies = ['{"lastUpdateId": 7, "bids": [["1.5", "2"], ["", "1"], ["3"], ["x", "1"]], "asks": []}', '{"lastUpdateId": "7"}', "[", None,
              '{"lastUpdateId": 8, "bids": null, "asks": [["2.25", "4"]]}']
    df = responses(spark, [("depth", "A", 20, b) for b in bodies] + [("aggTrades", "A", 20, "[]")])
    staged = decode_order_book(df, staged="books-test")
    plain = decode_order_book(df.withColumn("response_no", F.monotonically_increasing_id()))
    for a, b in zip(staged, plain):
        assert a.columns == b.columns and sorted(map(str, a.drop("snapshot_id").collect())) == sorted(map(str, b.drop("snapshot_id").collect()))
        plan = a._jdf.queryExecution().executedPlan().toString()
        assert "parse_json" not in plan and "from_json" not in plan
    assert [tuple(r) for r in staged.levels.join(staged.headers, "snapshot_id").select("price").collect()]
