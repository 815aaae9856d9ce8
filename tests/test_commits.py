"""Commits over several tables, the key index and compaction."""

import datetime as dt
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quayside.operators.commit_log import CommitConflict, CommitLog
from quayside.operators.ingest import TradeStore, ingest_trade_pages
from quayside.operators.key_index import IDS_PER_BLOCK
from quayside.operators.write import VersionedTable, write_layout, write_shards
from quayside.schemas import RESPONSE_DDL
from quayside.session import scratch_dir


def pages(spark, trades, symbol="S"):
    items = [{"a": a, "p": p, "q": "1", "f": a, "l": a, "T": 1704067200000 + a, "m": True, "M": True} for a, p in trades]
    return spark.createDataFrame([("aggTrades", symbol, None, 200, None, None, json.dumps(items), dt.datetime(2024, 1, 1))], RESPONSE_DDL)


def batch(spark, keys, price=1):
    ddl = "symbol string, agg_trade_id long, price decimal(38,18), quantity decimal(38,18), first_trade_id long, last_trade_id long, " \
          "trade_time timestamp_ntz, is_buyer_maker boolean, is_best_match boolean, ym int, _ord int"
    at = dt.datetime(2024, 1, 1)
    import decimal
    one = decimal.Decimal(price)
    return spark.createDataFrame([(s, i, one, one, i, i, at + dt.timedelta(seconds=i % 5_000_000), True, True, 202401, k) for k, (s, i) in enumerate(keys)], ddl)


def test_a_commit_shows_all_of_its_tables_or_none(spark, monkeypatch):
    store = TradeStore(spark, scratch_dir(spark, "atomic"))
    ingest_trade_pages(store, pages(spark, [(1, "10")]))
    before = (rows(store.trades(), "agg_trade_id"), rows(store.marks(), "last_id"))

    def killed(self, file, text):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr("quayside.operators.commit_log.SharedFolder.put_if_absent", killed)
        with pytest.raises(KeyboardInterrupt):   # all folders are written, nothing is published
            ingest_trade_pages(store, pages(spark, [(2, "10"), (3, "")]), batch_id=1)
    assert (rows(store.trades(), "agg_trade_id"), rows(store.marks(), "last_id")) == before
    assert ingest_trade_pages(store, pages(spark, [(2, "10"), (3, "")]), batch_id=1) == {"attempted": 1, "inserted": 1}
    assert rows(store.trades(), "agg_trade_id") == [(1,), (2,)] and rows(store.marks(), "last_id") == [(3,)]
    assert rows(store.rejects(), "item", "batch_id") == [("3", 1)]


def test_of_two_writers_one_wins_and_the_other_starts_again(spark):
    store = TradeStore(spark, scratch_dir(spark, "two"))
    seen = store.log.snapshot()
    store.insert(batch(spark, [("S", 1), ("S", 2)]), "_ord", seen)
    with pytest.raises(CommitConflict):
        store.insert(batch(spark, [("S", 2), ("S", 3)]), "_ord", seen)
    assert rows(store.trades(), "agg_trade_id") == [(1,), (2,)]   # the loser's folders are not read

    late = TradeStore(spark, store.root)
    old = store.log.snapshot()
    stale = iter([old])
    real = CommitLog.snapshot
    # the second writer reads the version that a first one is about to replace
    store.insert(batch(spark, [("S", 5)], price=2), "_ord", old)
    try:
        CommitLog.snapshot = lambda self, version=None: next(stale, None) or real(self, version)
        got = ingest_trade_pages(late, pages(spark, [(5, "9"), (6, "9")]), batch_id=7)
    finally:
        CommitLog.snapshot = real
    assert got == {"attempted": 2, "inserted": 1}
    assert rows(store.trades().filter("agg_trade_id = 5"), "price") == [(2,)] and store.trades().count() == 4


def test_put_if_absent_has_one_winner(spark):
    log = CommitLog(spark, scratch_dir(spark, "race"))
    seen, won = log.snapshot(), []

    def go(k):
        try:
            log.commit(seen, add={"t": {f"s{k}": f"{log.root}/t/commit_slot=p{k}"}})
            won.append(k)
        except CommitConflict:
            pass
    threads = [threading.Thread(target=go, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and log.versions() == [1] and list(log.snapshot().slots("t")) == [f"s{won[0]}"]
    assert [n for n, _ in log.files.names(f"{log.root}/_log") if n.endswith(".tmp")] == []
    # the same rule through Hadoop's rename, which other file systems use
    for name, want in (("a", True), ("a", False)):
        stream = log.files.fs.create(log.files.path(f"{log.root}/own"), True)
        stream.close()
        assert log.files._rename(f"{log.root}/own", f"{log.root}/{name}") is want


def test_a_late_version_never_displaces_a_committed_one(spark):
    root = scratch_dir(spark, "late")
    a, b = VersionedTable(spark, root), VersionedTable(spark, root)
    assert a.current_version() is b.current_version() is None
    a.commit(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(CommitConflict):
        b.commit(spark.createDataFrame([(2,)], "x int"))
    assert not b.log.files.put_if_absent(b.log._file(1), "{}")
    assert [r.x for r in VersionedTable(spark, root).read().collect()] == [1]


def test_key_index_probes_only_blocks_with_gaps(spark):
    far = 10 ** 12   # symbols of distant id spaces: no id range of one batch is narrow
    store = TradeStore(spark, scratch_dir(spark, "index"))
    full = [("A", i) for i in range(300)] + [("B", far + i) for i in range(300)]
    gaps = [("C", i) for i in range(0, 300, 2)]
    store.insert(batch(spark, full), "_ord", store.log.snapshot())
    store.insert(batch(spark, gaps), "_ord", store.log.snapshot(), batch_id=1)
    store.insert(batch(spark, [("D", 7 * IDS_PER_BLOCK)]), "_ord", store.log.snapshot(), batch_id=2)
    at = store.log.snapshot()
    slots = {r.symbol: r.slot for r in store.log.read("trade_keys", "symbol string, slot string", at).collect()}
    sure = batch(spark, [("A", 5), ("A", 300), ("B", far + 5), ("B", far - 1), ("E", 5), ("D", 7 * IDS_PER_BLOCK)])
    plan = store.missing(sure, "_ord", at)
    assert plan.probed == [] and rows(plan.new, "symbol", "agg_trade_id") == [("A", 300), ("B", far - 1), ("E", 5)]
    for s in ("A", "D"):   # files outside the probed folders are not opened: these could not be read
        for d, _, names in os.walk(at.slots("agg_trades")[slots[s]].removeprefix("file:")):
            for n in names:
                if n.endswith(".parquet"):
                    with open(f"{d}/{n}", "wb") as f:
                        f.write(b"unreadable")
    mixed = batch(spark, [("A", 299), ("C", 4), ("C", 5), ("C", 298), ("C", 400), ("C", 5), ("B", far)])
    plan = store.missing(mixed, "_ord", at)
    assert plan.probed == [slots["C"]] and rows(plan.new, "symbol", "agg_trade_id") == [("C", 5), ("C", 400)]


def test_compaction_bounds_the_folders_and_keeps_everything(spark):
    store = TradeStore(spark, scratch_dir(spark, "packed"), max_folders=5)
    for k in range(14):
        ingest_trade_pages(store, pages(spark, [(2 * k, "1"), (2 * k + 1, "2"), (k, "3")], symbol="AB"[k % 2]), batch_id=k)
    at = store.log.snapshot()
    assert max(len(at.slots(t)) for t in ("agg_trades", "trade_keys", "write_metrics")) <= 5
    assert set(at.slots("trade_keys")) == set(at.slots("agg_trades"))
    got = {(r.symbol, r.agg_trade_id) for r in store.trades().collect()}
    want = {("AB"[k % 2], i) for k in range(14) for i in (2 * k, 2 * k + 1, k)}
    assert got == want and store.trades().count() == len(want)
    counts = {r.batch_id: (r.attempted, r.inserted) for r in store.metrics().collect()}
    assert len(counts) == 14 and sum(i for _, i in counts.values()) == len(want)
    assert ingest_trade_pages(store, pages(spark, [(0, "1"), (1, "2"), (0, "3")], symbol="A"), batch_id=0)["inserted"] == 0
    assert store.compact() and not store.compact()
    folder = store.log.snapshot().slots("agg_trades")
    assert len(folder) == 1
    files = [f for d, _, n in os.walk(list(folder.values())[0].removeprefix("file:")) for f in n if f.endswith(".parquet")]
    assert len(files) <= 4   # at most one per sorting task
    before = sorted(got)
    gone = store.log.vacuum(keep=1, min_age_hours=0)
    assert gone and sorted((r.symbol, r.agg_trade_id) for r in store.trades().collect()) == before
    assert len(store.log.versions()) == 1 and store.log.vacuum(keep=1, min_age_hours=0) == []


def test_full_overwrites_leave_no_old_partition(spark):
    path = scratch_dir(spark, "static")
    month = lambda *m: spark.createDataFrame([(x, x) for x in m], "v int, ym int")
    for mode in ("dynamic", "static"):
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        try:
            write_layout(month(202401, 202402), path, partition_by=("ym",))
            write_layout(month(202402), path, partition_by=("ym",))
            assert rows(spark.read.parquet(path), "ym") == [(202402,)]
            shards = scratch_dir(spark, "static-shards")
            write_shards(spark.range(100), shards, ["id"], 4)
            write_shards(spark.range(1), shards, ["id"], 4)
            assert spark.read.parquet(shards).select("id").collect() == spark.range(1).collect()
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
