"""Stored stock snapshots: batches carried on and corrected equal the snapshot of all movements.
Sharded tables: a key's lookup lists one shard."""

import datetime as dt
import random

import pytest

from quayside.operators import aggregates as agg
from quayside.operators.commit_log import CommitConflict, CommitLog
from quayside.operators.snapshots import ROWS, StockSnapshots, start_snapshot_stream
from quayside.schemas import TABLES
from quayside.session import scratch_dir
from quayside.sources.tables import ShardedTable
from quayside.streaming.events import run_available

DDL = "product_id bigint, warehouse_id int, quantity int, movement_timestamp timestamp_ntz, extra string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def movements(spark, days, n=60, seed=1, undated=0):
    rnd = random.Random(seed)
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=rnd.randint(0, 23))
    data = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([1, 2, None]), rnd.choice([-5, -1, 3, 8]), at(rnd.choice(days)), "x") for _ in range(n)]
    return spark.createDataFrame([*data, *[(1, 1, 100 + k, None, "x") for k in range(undated)]], DDL)


def plain(df):
    return rows(agg.stock_snapshot(df).selectExpr("snapshot_date", "warehouse_id", "product_id", "quantity_on_hand", "last_restock_date"))


def stored(snaps):
    return rows(snaps.table().selectExpr("snapshot_date", "warehouse_id", "product_id", "quantity_on_hand", "last_restock_date"))


def test_batches_carry_on_and_late_movements_correct_what_follows(spark):
    snaps = StockSnapshots(spark, scratch_dir(spark, "snaps"), max_folders=4)
    want = [(f.name, f.dataType) for f in TABLES["inventory.warehouse_snapshots"].schema.fields]
    assert rows(snaps.table()) == [] and [(f.name, f.dataType) for f in snaps.table().schema.fields] == want
    batches = [range(0, 20), range(20, 50), range(95, 120), range(10, 100, 7), [44], range(0, 130)]
    everything = None
    for n, days in enumerate(batches):
        part = movements(spark, list(days), seed=n, undated=2 * (n in (1, 5)))
        assert snaps.update(part, n) and not snaps.update(part, n)
        everything = part if everything is None else everything.unionByName(part)
        assert stored(snaps) == plain(everything), n
    assert snaps.update(everything.limit(0), 99) and stored(snaps) == plain(everything)
    assert snaps.compact() and not snaps.compact() and stored(snaps) == plain(everything)


def test_a_later_day_rewrites_nothing_and_a_late_one_only_its_months(spark):
    snaps = StockSnapshots(spark, scratch_dir(spark, "snaps-days"))
    snaps.update(movements(spark, range(0, 100), seed=3), 0)
    before = set(snaps.log.snapshot().slots(ROWS))
    snaps.update(movements(spark, [130], seed=4), 1)
    after = set(snaps.log.snapshot().slots(ROWS))
    assert before < after and {s.split(".")[0] for s in after - before} == {"202405"}
    snaps.update(movements(spark, [65], seed=5), 2)      # 6 March: January and February stay
    last = set(snaps.log.snapshot().slots(ROWS))
    assert {s.split(".")[0] for s in after - last} == {"202403", "202404", "202405"}
    assert {s for s in after if s < "202403"} <= last


def test_a_batch_that_meets_another_is_worked_out_again(spark, monkeypatch):
    root = scratch_dir(spark, "snaps-two")
    a, b = StockSnapshots(spark, root), StockSnapshots(spark, root)
    first, second = movements(spark, range(30, 60), seed=6), movements(spark, range(0, 40), seed=7)
    commit, met = CommitLog.commit, []

    def late(self, seen, **changes):
        if not met:
            met.append(1)
            monkeypatch.setattr(CommitLog, "commit", commit)
            assert b.update(second, 0, "other")
        return commit(self, seen, **changes)

    monkeypatch.setattr(CommitLog, "commit", late)
    assert a.update(first, 0, "one")
    assert stored(a) == plain(first.unionByName(second))
    monkeypatch.setattr(CommitLog, "commit", lambda *x, **y: (_ for _ in ()).throw(CommitConflict("taken")))
    with pytest.raises(CommitConflict):
        a.update(second, 1, "one")
    monkeypatch.undo()
    assert stored(a) == plain(first.unionByName(second))


def test_old_months_go_and_live_ones_stay_when_the_log_is_cleaned(spark):
    snaps = StockSnapshots(spark, scratch_dir(spark, "snaps-vacuum"))
    for n, days in enumerate([range(0, 60), range(60, 90), [0, 70]]):
        snaps.update(movements(spark, list(days), seed=n), n)
    want = stored(snaps)
    snaps.compact()
    assert snaps.log.vacuum(keep=1, min_age_hours=0) and stored(snaps) == want


def test_a_stream_keeps_its_snapshots(spark):
    src, ck = scratch_dir(spark, "snaps-src"), scratch_dir(spark, "snaps-ck")
    snaps = StockSnapshots(spark, scratch_dir(spark, "snaps-stream"))
    for k in range(2):
        movements(spark, range(10 * k, 10 * k + 15), seed=k).write.mode("append").parquet(src)
        run_available(start_snapshot_stream(snaps, spark.readStream.schema(DDL).parquet(src), ck, {"availableNow": True}))
    assert stored(snaps) == plain(spark.read.schema(DDL).parquet(src))


def test_a_lookup_reads_one_shard(spark):
    spec = TABLES["inventory.stock_movements"]
    df = movements(spark, range(0, 60), n=300).selectExpr("*", "cast(year(movement_timestamp) * 100 + month(movement_timestamp) as int) as ym")
    t = ShardedTable(spark, scratch_dir(spark, "shards6"), spec, ("product_id",), 16)
    t.write(df)
    assert rows(t.read().select(df.columns)) == rows(df)
    for value in (1, 2, None, 77):
        got = t.lookup(value)
        assert rows(got.select(df.columns)) == [r for r in rows(df) if r[0] == value]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(shard" in plan and "shard#" in plan and "xxhash64" not in plan
    key_dir = scratch_dir(spark, "shard-keys")
    spark.createDataFrame([(1, 1), (3, 2), (1, 3), (2, 9)], "product_id int, n int").write.parquet(key_dir)
    found = t.join_keys(spark.read.parquet(key_dir).where("n < 5"))
    assert rows(found.select(df.columns)) == [r for r in rows(df) if r[0] in (1, 3)]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    t.write(df.limit(1))
    assert t.read().count() == 1
    t.write(df.limit(0), mode="append")
    assert t.read().count() == 1


def test_rows_meet_their_balances_in_one_shuffle(spark):
    from quayside.operators.snapshots import BALANCE_DDL, ROWS_DDL, balance_of, daily_net, running_rows
    from quayside.session import stage
    daily = stage(daily_net(movements(spark, range(0, 40))), "daily-test")
    balance = spark.createDataFrame(stage(balance_of(daily), "balance-test").collect(), BALANCE_DDL)
    out = running_rows(daily, spark.createDataFrame([], ROWS_DDL), balance)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    snaps = StockSnapshots(spark, scratch_dir(spark, "snaps-store"))
    snaps.update(movements(spark, range(0, 100)), 0)
    snaps.store(path := scratch_dir(spark, "snaps-stored"))
    kept = spark.read.schema(TABLES["inventory.warehouse_snapshots"].ddl).parquet(path)
    assert rows(kept) == rows(snaps.table())
