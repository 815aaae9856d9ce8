import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from quayside.operators.ingest import TradeStore, ingest_trade_pages
from quayside.operators.write import (VersionedTable, add_month, advance_marks, bootstrap, high_water_marks, insert_ignore,
                                      keep_first, keep_last, upsert, write_layout)
from quayside.plans import standins as si
from quayside.schemas import RESPONSE_DDL, TABLES
from quayside.session import scratch_dir


def test_keep_first_and_last_by_ordinal(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 5, "w")], "k string, o int, v string")
    assert rows(keep_last(df, ["k"], "o"), "k", "v") == [("a", "z"), ("b", "w")]
    assert rows(keep_first(df, ["k"], "o"), "k", "v") == [("a", "x"), ("b", "w")]


def test_upsert_last_duplicate_wins_and_untouched_rows_stay(spark):
    target = spark.createDataFrame([("A", "TRADING"), ("B", "BREAK")], "symbol string, status string")
    batch = spark.createDataFrame([("B", "HALT", 1), ("B", "TRADING", 2), ("C", "NEW", 1)],
                                  "symbol string, status string, ord int")
    assert rows(upsert(target, batch, ["symbol"], "ord")) == [("A", "TRADING"), ("B", "TRADING"), ("C", "NEW")]


def test_insert_ignore_existing_then_first_duplicate(spark):
    target = spark.createDataFrame([("S", 1, 10)], "symbol string, id long, price int")
    batch = spark.createDataFrame([("S", 1, 99, 0), ("S", 2, 20, 1), ("S", 2, 21, 2)],
                                  "symbol string, id long, price int, ord int")
    res = insert_ignore(target, batch, ["symbol", "id"], "ord")
    assert rows(res.inserted, "symbol", "id", "price") == [("S", 2, 20)]
    assert rows(res.metrics) == [("S", 3, 1)]


def test_marks_overwrite_or_monotone(spark):
    state = spark.createDataFrame([("agg_trades", "S", 100, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2))],
                                  TABLES["crypto.ingest_state"].ddl)
    marks = spark.createDataFrame([("agg_trades", "S", 50, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3))],
                                  TABLES["crypto.ingest_state"].ddl)
    assert rows(advance_marks(state, marks), "last_id") == [(50,)]            # reference: moves back
    assert rows(advance_marks(state, marks, monotone=True), "last_id", "last_timestamp") == [
        (100, dt.datetime(2024, 1, 2))]


def test_high_water_mark_takes_time_of_max_id(spark):
    t = spark.createDataFrame([("S", 1, dt.datetime(2024, 1, 5)), ("S", 7, dt.datetime(2024, 1, 3))],
                              "symbol string, agg_trade_id long, trade_time timestamp_ntz")
    assert rows(high_water_marks(t), "symbol", "last_id", "last_timestamp") == [("S", 7, dt.datetime(2024, 1, 3))]


def test_versioned_table_commits_new_versions(spark):
    vt = VersionedTable(spark, scratch_dir(spark, "vt-test"))
    assert vt.read() is None
    vt.commit(spark.range(3))
    vt.commit(vt.read().filter("id > 0"))
    assert vt.versions() == [1, 2] and vt.read().count() == 2
    spark.range(7).write.parquet(f"{vt.root}/v=000003")   # a crashed rewrite: data but no log row
    assert vt.versions() == [1, 2] and vt.read().count() == 2
    vt.commit(spark.range(5))                               # takes over the abandoned folder
    assert vt.versions() == [1, 2, 3] and vt.read().count() == 5


def test_bootstrap_twice_is_idempotent(spark):
    root = scratch_dir(spark, "boot-test")
    a = bootstrap(spark, root, prefix="bt_")
    b = bootstrap(spark, root, prefix="bt_")
    assert a == b and len(a) == len(TABLES)
    spark.sql("INSERT INTO bt_app.events (event_id, user_id, event_type, payload) VALUES (1, 2, 'x', NULL)")
    r = spark.table("bt_app.events").first()
    assert r.created_at is not None  # DEFAULT applied


def test_layout_prunes_by_month_and_key(spark):
    path = scratch_dir(spark, "layout-test")
    ue = si.user_events(spark, SF_SMALL).withColumn("ym", F.year("event_timestamp") * 100 + F.month("event_timestamp"))
    spec = TABLES["analytics.user_events"]
    write_layout(ue, path, partition_by=spec.partition_by, sort_by=spec.sort_by, bloom=spec.bloom)
    q = spark.read.parquet(path).filter((F.col("ym") == 202401) & (F.col("user_id") == 3))
    plan = q._jdf.queryExecution().executedPlan().toString()


def _pages(spark, trades):
    items = [{"a": a, "p": p, "q": "1", "f": a, "l": a, "T": 1704067200000 + a, "m": True, "M": True}
             for a, p in trades]
    return spark.createDataFrame([("aggTrades", "S", None, 200, None, None, json.dumps(items),
                                   dt.datetime(2024, 1, 1))], RESPONSE_DDL)


def test_ingest_replay_inserts_nothing_and_keeps_marks(spark):
    store = TradeStore(spark, scratch_dir(spark, "ingest-test"))
    r0 = ingest_trade_pages(store, _pages(spark, [(7, "")]), batch_id=9)            # all rows invalid
    assert r0 == {"attempted": 0, "inserted": 0} and rows(store.marks(), "last_id") == [(7,)]
    r1 = ingest_trade_pages(store, _pages(spark, [(1, "10"), (2, "11"), (3, "")]), batch_id=0)
    r2 = ingest_trade_pages(store, _pages(spark, [(2, "99"), (3, "12"), (4, "13")]), batch_id=1)
    r3 = ingest_trade_pages(store, _pages(spark, [(2, "99"), (3, "12"), (4, "13")]), batch_id=2)  # replay
    assert (r1, r2, r3) == ({"attempted": 2, "inserted": 2}, {"attempted": 3, "inserted": 2},
                            {"attempted": 3, "inserted": 0})
    assert rows(store.trades(), "agg_trade_id", "price") == [(1, 10), (2, 11), (3, 12), (4, 13)]
    assert rows(store.marks(), "symbol", "last_id") == [("S", 4)]
    assert spark.read.parquet(store.rejects_path).count() == 2


def test_split_valid_quarantines_rows_by_first_broken_rule(spark):
    from quayside.operators.quality import split_valid
    spec = TABLES["app.events"]
    df = spark.createDataFrame([(1, 1, "ok", None, dt.datetime(2024, 1, 1)), (2, None, "x", None, dt.datetime(2024, 1, 1)),
                                (3, 3, "y" * 65, None, dt.datetime(2024, 1, 1))], spec.ddl)
    good, bad = split_valid(df, spec)
    assert rows(good, "event_id") == [(1,)]
    assert rows(bad, "event_id", "rule") == [(2, "not_null:user_id"), (3, "max_length:event_type<=64")]


def test_insert_ignore_probe_is_bounded_by_the_batch(spark):
    path = scratch_dir(spark, "probe-test")
    t = spark.range(0, 100000).select(F.lit("S").alias("symbol"), F.col("id").alias("agg_trade_id"),
                                      (F.col("id") % 3).cast("int").alias("ym"))
    write_layout(t, path, partition_by=("ym",), sort_by=("symbol", "agg_trade_id"))
    target = spark.read.parquet(path)
    batch = spark.createDataFrame([("S", 99998, 2, 0), ("S", 100001, 2, 1)],
                                  "symbol string, agg_trade_id long, ym int, ord int")
    res = insert_ignore(target, batch, ["symbol", "agg_trade_id"], "ord", range_col="agg_trade_id")
    assert rows(res.inserted, "agg_trade_id") == [(100001,)]
    plan = res.inserted._jdf.queryExecution().executedPlan().toString()
    # the month is no key column, so only the id range may narrow the probe
    assert "GreaterThanOrEqual(agg_trade_id,99998)" in plan


def test_upsert_partitions_rewrites_only_touched_partitions(spark):
    import os
    from quayside.operators.write import upsert_partitions
    path = scratch_dir(spark, "uparts")
    base = spark.createDataFrame([("A", 1, 202401, "x", 0), ("B", 2, 202402, "y", 0)],
                                 "symbol string, id long, ym int, v string, ord int")
    upsert_partitions(spark, path, base, ["symbol", "id"], "ord", "ym")
    untouched = sorted(os.listdir(f"{path}/ym=202401"))
    batch = spark.createDataFrame([("B", 2, 202402, "y1", 1), ("B", 2, 202402, "y2", 2), ("C", 3, 202402, "z", 1)],
                                  "symbol string, id long, ym int, v string, ord int")
    assert upsert_partitions(spark, path, batch, ["symbol", "id"], "ord", "ym") == [202402]
    assert rows(spark.read.parquet(path), "symbol", "v", "ym") == [("A", "x", 202401), ("B", "y2", 202402),
                                                                  ("C", "z", 202402)]
    assert sorted(os.listdir(f"{path}/ym=202401")) == untouched      # never rewritten


def test_strict_batch_aborts_before_writing(spark):
    import pytest
    from quayside.operators.ingest import RejectedBatch
    store = TradeStore(spark, scratch_dir(spark, "strict-test"))
    with pytest.raises(RejectedBatch):
        ingest_trade_pages(store, _pages(spark, [(1, "10"), (2, "x")]), strict_batch=True)
    assert store.trades().count() == 0 and store.state.versions() == []
    assert ingest_trade_pages(store, _pages(spark, [(1, "10")]), strict_batch=True)["inserted"] == 1


def test_shards_are_deterministic_and_complete(spark):
    from quayside.operators.write import write_shards
    from quayside.sources.tables import read_shards
    df = spark.range(0, 5000).withColumnRenamed("id", "event_id")
    a = write_shards(df, scratch_dir(spark, "sh-a"), ["event_id"], 3)
    b = write_shards(df.repartition(7), scratch_dir(spark, "sh-b"), ["event_id"], 3)   # a "retry" with other splits
    for pa, pb in zip(a, b):
        assert rows(spark.read.parquet(pa)) == rows(spark.read.parquet(pb))
    assert read_shards(spark, a).count() == 5000


def test_observed_append_counts_rows_written(spark):
    from quayside.operators.write import observed_append
    path = scratch_dir(spark, "obs")
    assert observed_append(spark.range(42), path, "obs_test")["rows"] == 42
    assert spark.read.parquet(path).count() == 42


def test_month_filter_prunes_partitions(spark):
    from quayside.operators.write import add_month, month_filter
    path = scratch_dir(spark, "mf")
    df = spark.createDataFrame([(dt.datetime(2024, m, 15), m) for m in (1, 2, 3)], "ts timestamp_ntz, v int")
    write_layout(add_month(df, "ts"), path, partition_by=("ym",), sort_by=("ts",))
    q = spark.read.parquet(path).filter(month_filter("ts", "2024-02-01 00:00:00", "2024-02-28 00:00:00"))
    assert rows(q, "v") == [(2,)]
    assert "(ym#" in q._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_layout_spreads_a_hot_month_over_several_files(spark):
    import os
    path = scratch_dir(spark, "hot-month")
    t = spark.range(0, 20000).select((F.col("id") % 7).alias("user_id"),
                                     F.when(F.col("id") % 10 == 0, 202402).otherwise(202401).alias("ym"),
                                     F.col("id").alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_layout(t, path, partition_by=("ym",), sort_by=("user_id", "ts"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = [f for f in os.listdir(f"{path}/ym=202401") if f.endswith(".parquet")]
    assert len(hot) > 1                                     # the 90 % month is written by several tasks
    assert spark.read.parquet(path).count() == 20000


def test_ensure_table_is_idempotent_and_keeps_rows(spark):
    from quayside.operators.write import ensure_table
    path = scratch_dir(spark, "ensure")
    ddl = "k string, v int, ym int"
    ensure_table(spark, path, ddl, ("ym",))
    assert spark.read.schema(ddl).parquet(path).count() == 0
    spark.createDataFrame([("a", 1, 202401)], ddl).write.mode("append").partitionBy("ym").parquet(path)
    ensure_table(spark, path, ddl, ("ym",))
    assert rows(spark.read.schema(ddl).parquet(path), "k", "v", "ym") == [("a", 1, 202401)]


def test_commit_conflict_keeps_the_first_writer(spark):
    from quayside.operators.write import CommitConflict
    root = scratch_dir(spark, "vt-conflict")
    a, b = VersionedTable(spark, root), VersionedTable(spark, root)
    a.commit(spark.createDataFrame([(1,)], "x int"))
    assert b.current_version() == 1
    a.commit(spark.createDataFrame([(2,)], "x int"))
    with pytest.raises(CommitConflict):
        b.commit(spark.createDataFrame([(3,)], "x int"))
    assert [r.x for r in VersionedTable(spark, root).read().collect()] == [2]


def test_stored_key_with_another_month_is_ignored(spark):
    target = spark.createDataFrame([("A", 1, 202401)], "symbol string, agg_trade_id bigint, ym int")
    batch = spark.createDataFrame([("A", 1, 202402, 1)], "symbol string, agg_trade_id bigint, ym int, o int")
    assert insert_ignore(target, batch, ["symbol", "agg_trade_id"], "o", range_col="agg_trade_id").inserted.count() == 0
    with pytest.raises(ValueError):
        insert_ignore(target, batch, ["symbol", "agg_trade_id"], "o", prune_col="ym")


def test_streams_and_replays_keep_each_others_rows(spark):
    from quayside.operators.write import stream_key, write_batch_partition
    path = scratch_dir(spark, "streams")
    for ck, x in (("a", 1), ("b", 2), ("a", 1)):
        write_batch_partition(spark.createDataFrame([(x,)], "x int"), path, 0, stream_key(ck))
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 2]


def test_replayed_trade_batch_changes_nothing(spark):
    store = TradeStore(spark, scratch_dir(spark, "replay"))
    pages = _pages(spark, [(1, "10"), (2, "")])
    for _ in range(2):
        ingest_trade_pages(store, pages, batch_id=3)
    assert store.trades().count() == 1 and spark.read.parquet(store.rejects_path).count() == 1
    assert [(r.attempted, r.inserted) for r in store.metrics().collect()] == [(1, 1)]


def test_empty_shard_is_readable(spark):
    from quayside.operators.write import write_shards
    from quayside.sources.tables import read_shards
    paths = write_shards(spark.createDataFrame([(1,)], "x int"), scratch_dir(spark, "few"), ["x"], 4)
    assert read_shards(spark, paths).count() == 1


def test_large_folders_are_dealt_by_ranges_of_their_key(spark):
    from quayside.operators.write import deal_folders
    keys = [(202401 if i % 10 else None, None if i == 50 else i, f"v{i}") for i in range(3000)] + [(202402, 7, "few")]
    df = spark.createDataFrame(keys, "ym int, k int, v string")
    for given in (None, df.select("ym", "k").unionByName(df.select("ym", "k"))):
        dealt = deal_folders(df, ["ym"], ["k"], given, rows=100).withColumn("task", F.spark_partition_id())
        got = [tuple(r) for r in dealt.collect()]
        assert sorted((r[:3] for r in got), key=str) == sorted(keys, key=str)
        for ym in (None, 202401):   # the ranges of a folder do not overlap, each in its order
            spans = {}
            for m, k, _, task in got:
                if m == ym:
                    spans.setdefault(task, []).append(-1 if k is None else k)
            assert len(spans) > 1 and all(s == sorted(s) for s in spans.values())
            ends = sorted((s[0], s[-1]) for s in spans.values())
            assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert deal_folders(df.limit(0), ["ym"], ["k"]).count() == 0


def test_a_derived_table_is_worked_out_once_when_it_is_dealt(spark):
    from quayside.schemas import TABLES
    from quayside.sources.tables import ShardedTable
    worked = spark.sparkContext.accumulator(0)

    def seen(n):
        worked.add(1)
        return n

    days = spark.range(200).selectExpr("date'2024-01-01' + cast(id % 40 as int) as snapshot_date", "cast(id % 3 as int) as warehouse_id",
                                       "id as product_id")
    days = add_month(days, "snapshot_date")
    t = ShardedTable(spark, scratch_dir(spark, "shards-once"), TABLES["inventory.warehouse_snapshots"], ("warehouse_id", "product_id"), 2)
    t.write(days.withColumn("quantity_on_hand", F.udf(seen, "bigint")("product_id")), keys=days)
    assert worked.value == 200
    assert t.read().count() == 200 and t.lookup(1, 1).count() == 1
    t.write(days.withColumn("quantity_on_hand", F.udf(seen, "bigint")("product_id")))   # without keys: only the key's columns are passed twice
    assert worked.value == 400
