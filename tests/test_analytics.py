import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, rows
from quayside.operators import aggregates as agg, paging, telemetry
from quayside.plans import standins as si


def _naive_sessions(df, gap_s):
    w = Window.partitionBy("user_id").orderBy("event_timestamp", "event_id")
    prev = F.lag("event_timestamp").over(w)
    new = F.when(prev.isNull() | (F.timestamp_diff("MICROSECOND", prev, "event_timestamp") > gap_s * 1_000_000), 1) \
           .otherwise(0)
    return df.withColumn("_n", new).withColumn("session_no", F.sum("_n").over(w).cast("bigint"))


def test_bucketed_sessionize_equals_single_pass(spark):
    ue = si.user_events(spark, SF_MID)
    gap = 8 * 3600
    want = rows(_naive_sessions(ue, gap), "event_id", "session_no")
    for bucket in (600, 3600, 86400 * 40):   # buckets far smaller than, and larger than, the gap
        got = rows(agg.sessionize(ue, "user_id", "event_timestamp", "event_id", gap, bucket_seconds=bucket),
                   "event_id", "session_no")
        assert got == want


def test_sessionize_edge_gap(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(1, 1, t0), (2, 1, t0 + dt.timedelta(hours=8)), (3, 1, t0 + dt.timedelta(hours=16, microseconds=1)),
            (4, 2, t0)]
    df = spark.createDataFrame(data, "event_id long, user_id long, event_timestamp timestamp_ntz")
    got = rows(agg.sessionize(df, "user_id", "event_timestamp", "event_id", 8 * 3600, bucket_seconds=3600),
               "event_id", "session_no")
    assert got == [(1, 1), (2, 1), (3, 2), (4, 1)]   # a gap of exactly 8 h continues the session


def test_stock_snapshot_running_sum(spark):
    d = dt.datetime
    m = spark.createDataFrame([(1, 1, 5, d(2024, 1, 1)), (1, 1, -2, d(2024, 1, 1, 5)), (1, 1, -1, d(2024, 1, 3)),
                               (1, 1, 4, d(2024, 1, 4))],
                              "product_id long, warehouse_id int, quantity int, movement_timestamp timestamp_ntz")
    got = rows(agg.stock_snapshot(m), "snapshot_date", "quantity_on_hand", "last_restock_date")
    assert got == [(dt.date(2024, 1, 1), 3, dt.date(2024, 1, 1)), (dt.date(2024, 1, 3), 2, dt.date(2024, 1, 1)),
                   (dt.date(2024, 1, 4), 6, dt.date(2024, 1, 4))]


def test_incremental_page_with_and_without_state(spark):
    t = spark.createDataFrame([(s, i) for s in ("A", "B") for i in range(1, 3001)], "symbol string, agg_trade_id long")
    state = spark.createDataFrame([("agg_trades", "A", 1500)], "worker_type string, symbol string, last_id long")
    p = paging.incremental_page(t, state)
    got = p.groupBy("symbol").agg(F.min("agg_trade_id"), F.max("agg_trade_id"), F.count("*")).orderBy("symbol").collect()
    assert [tuple(r) for r in got] == [("A", 1501, 2500, 1000), ("B", 2001, 3000, 1000)]
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2   # partial top-k before each shuffle
    assert "hashpartitioning(symbol#" in plan and ", _salt#" in plan   # a hot symbol is split first


def test_disposition_and_alerts(spark):
    df = spark.createDataFrame([(200, "", "1"), (418, "", "4800"), (429, "5", "5700"), (429, "x", " 12"),
                                (400, "", ""), (503, "", "abc"), (404, "", "+4900")],
                               "status int, retry_after string, used_weight string")
    got = df.select(telemetry.disposition(F.col("status"), F.col("retry_after")),
                    telemetry.weight_alert(F.col("used_weight"))).collect()
    assert [tuple(r) for r in got] == [("ok", "ok"), ("ban", "warn"), ("retry_after_header", "pause"),
                                       ("retry_backoff", "none"), ("skip", "none"), ("retry_backoff", "none"),
                                       ("error", "warn")]


def test_sessionize_hot_user_is_split_across_tasks(spark):
    """One user holds a third of all events: results still equal the single pass, and the
    row-level window is partitioned by (user, bucket), not by user alone."""
    ue = si.user_events(spark, SF_MID).withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    gap = 8 * 3600
    out = agg.sessionize(ue, "user_id", "event_timestamp", "event_id", gap, bucket_seconds=3600)
    assert rows(out, "event_id", "session_no") == rows(_naive_sessions(ue, gap), "event_id", "session_no")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep the tiny shuffle's partitions
    try:
        hot = out.filter("user_id = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert hot > 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id#" in plan and ", _b#" in plan


def test_ticker_hot_symbol_partial_aggregation(spark):
    t = si.agg_trades(spark, SF_MID).withColumn(
        "symbol", F.when(F.col("agg_trade_id") % 3 == 0, F.lit("HOT")).otherwise(F.col("symbol")))
    tk = agg.ticker_from_trades(t)
    plan = tk._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "partial_sum" in plan   # reduced before the shuffle
    assert tk.filter("symbol = 'HOT'").count() == 1


def test_ticker_since_bound_prunes_without_changing_result(spark):
    t = si.agg_trades(spark, SF_MID)
    full = rows(agg.ticker_from_trades(t))
    bounded = agg.ticker_from_trades(t, since="2024-01-28 00:00:00")
    assert rows(bounded) == full
    assert "trade_time#" in bounded._jdf.queryExecution().optimizedPlan().toString()


def test_weight_budget_minute_total(spark):
    d = dt.datetime(2024, 1, 1, 0, 0, 5)
    r = spark.createDataFrame([("exchangeInfo", d)] * 200 + [("aggTrades", d)] * 600 + [("aggTrades", d.replace(minute=1))],
                              "endpoint string, fetched_at timestamp_ntz")
    got = rows(telemetry.weight_budget(r), "minute_start", "endpoint", "weight_used", "minute_weight", "over_budget")
    assert got == [(dt.datetime(2024, 1, 1, 0, 0), "aggTrades", 1200, 5200, True),
                   (dt.datetime(2024, 1, 1, 0, 0), "exchangeInfo", 4000, 5200, True),
                   (dt.datetime(2024, 1, 1, 0, 1), "aggTrades", 2, 2, False)]


def test_stock_snapshot_with_stock_levels(spark):
    d = dt.datetime
    m = spark.createDataFrame([(1, 1, 5, d(2024, 1, 1)), (2, 1, 9, d(2024, 1, 1))],
                              "product_id long, warehouse_id int, quantity int, movement_timestamp timestamp_ntz")
    levels = spark.createDataFrame([(1, 1, 2, 10)], "warehouse_id int, product_id long, quantity_reserved int, "
                                                    "reorder_point int")
    got = rows(agg.stock_snapshot(m, stock_levels=levels), "product_id", "quantity_on_hand", "quantity_reserved",
               "quantity_available", "reorder_point")
    assert got == [(1, 5, 2, 3, 10), (2, 9, 0, 9, 0)]


def test_daily_rollup_many_metrics_equals_one_by_one(spark):
    e = spark.read.parquet(f"{SF_MID}/events.parquet").withColumn(
        "k", F.get_json_object("props", "$.k").cast("double"))
    both = agg.daily_rollup_metrics(e, "ts", {"value": "value", "k": "k"}, "event_type", "user_id")
    one = agg.daily_rollup(e, "ts", "value", "event_type", "user_id", "value").unionByName(
        agg.daily_rollup(e, "ts", "k", "event_type", "user_id", "k"))
    assert rows(both) == rows(one)


def test_session_facts_on_real_session_ids(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame(
        [(1, 7, "s-a", t0, "/a", 1.5, "mobile"), (2, 7, "s-a", t0 + dt.timedelta(seconds=90), "/b", 2.0, "mobile"),
         (3, 7, "s-b", t0 + dt.timedelta(days=1), "/c", 0.5, "desktop")],
        "event_id long, user_id long, session_id string, event_timestamp timestamp_ntz, page_url string, "
        "duration_seconds double, device_type string")
    out = agg.session_facts(ev, session_col="session_id")
    assert out.columns.count("session_id") == 1
    assert rows(out, "session_id", "page_count", "session_seconds", "entry_url", "exit_url", "is_bounce") == [
        ("s-a", 2, 90, "/a", "/b", False), ("s-b", 1, 0, "/c", "/c", True)]


def test_events_without_a_time_keep_their_rows(spark):
    import datetime as dt
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, at, "a", 1.0, "m"), (2, 1, None, "b", 1.0, "m"), (3, 1, None, "c", 1.0, "m"), (4, None, at, "d", 1.0, "m"), (5, None, None, "e", 1.0, "m")],
                               "event_id long, user_id long, event_timestamp timestamp_ntz, page_url string, duration_seconds double, device_type string")
    s = agg.sessionize(df, "user_id", "event_timestamp", "event_id", 1800)
    got = sorted((r.event_id, r.session_no) for r in s.collect())
    assert [e for e, _ in got] == [1, 2, 3, 4, 5] and dict(got)[1] == 3 and {dict(got)[2], dict(got)[3]} == {1, 2}
    assert agg.session_facts(s).count() == 5


def test_gap_session_facts_equal_the_row_level_sessions(spark):
    """Also with a user that holds a third of all events, in one hour, with gaps from a second
    to a month and blocks of a few cells."""
    ue = si.user_events(spark, SF_MID)
    hot = ue.withColumns({"user_id": F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")),
                          "event_timestamp": F.when(F.col("event_id") % 3 == 0, F.timestamp_micros(F.lit(1704067200_000_000) + F.col("event_id") * 100_000).cast("timestamp_ntz"))
                          .otherwise(F.col("event_timestamp"))})
    cols = ["user_id", "session_no", "started_at", "ended_at", "page_count", "total_duration_seconds", "entry_url", "exit_url", "device_type"]
    for df in (ue, hot):
        for gap, block in ((8 * 3600, 4096), (1, 3), (30 * 86400, 1), (3600, 2)):
            want = rows(agg.session_facts(agg.sessionize(df, "user_id", "event_timestamp", "event_id", gap)), *cols)
            assert rows(agg.gap_session_facts(df, gap, cells_per_block=block), *cols) == want
    nothing = agg.gap_session_facts(ue.limit(0), 60)
    assert nothing.count() == 0


def test_gap_session_facts_reduce_a_hot_hour_inside_the_tasks(spark):
    t0 = dt.datetime(2024, 1, 1)
    hot = spark.range(0, 200_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("user_id"), F.col("id").alias("event_id"),
        (F.lit(t0).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") % 3600).cast("decimal(18,6)"))).alias("event_timestamp"),
        F.lit("u").alias("page_url"), F.lit(1.0).alias("duration_seconds"), F.lit("d").alias("device_type"))
    out = agg.gap_session_facts(hot, 3600)
    r = out.filter("user_id = 0").collect()
    assert len(r) == 1 and r[0].page_count == 66_667
    # windows see staged cells (u, cell, t0, ...), never events
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "event_timestamp#" not in plan and "page_url#" not in plan


def test_gap_session_facts_of_events_without_a_time_or_user(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, at, "a", 1.0, "m"), (2, 1, None, "b", 1.0, "m"), (3, 1, None, "c", None, "m"), (4, None, at, None, 1.0, "m"), (5, None, None, "e", 1.0, None)],
                               "event_id long, user_id long, event_timestamp timestamp_ntz, page_url string, duration_seconds double, device_type string")
    got = {(r.user_id, r.session_no): (r.page_count, r.started_at, r.entry_url, r.exit_url) for r in agg.gap_session_facts(df, 1800).collect()}
    assert got == {(1, 1): (2, None, "b", "c"), (1, 2): (1, at, "a", "a"), (None, 1): (1, None, "e", "e"), (None, 2): (1, at, None, None)}
