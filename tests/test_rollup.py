"""The stored daily rollup: batches add up to the rollup of all events."""

import datetime as dt
import random

from quayside.operators import aggregates as agg
from quayside.operators.rollup import DailyRollup, start_rollup_stream
from quayside.session import scratch_dir
from quayside.streaming.events import run_available

def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


DDL = "ts timestamp_ntz, event_type string, user_id long, value double, other double"


def events(spark, n=400, seed=1):
    rnd = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    data = [(at + dt.timedelta(hours=rnd.randint(0, 99)), rnd.choice("abc"), rnd.choice([0, -1, -40000, 1, 32768, 32769, 10 ** 12, None]),
             rnd.choice([None, 1.25, -3.5, 7.0]), 1.0) for _ in range(n)]
    return spark.createDataFrame([*data, (None, None, 3, 2.0, 1.0)], DDL)


def test_batches_add_up_and_repeats_add_nothing(spark):
    df = events(spark).cache()
    want = rows(agg.daily_rollup_metrics(df, "ts", {"value": "value", "other": "other"}, "event_type", "user_id"))
    roll = DailyRollup(spark, scratch_dir(spark, "roll"), {"value": "value", "other": "other"}, max_folders=3)
    assert rows(roll.table()) == []
    parts = df.randomSplit([1.0] * 6, seed=3)
    for n, part in enumerate(parts):
        assert roll.update(part, n)
        assert not roll.update(part, n)
    assert not roll.update(parts[0], 0)
    assert len(roll.log.snapshot().slots("rollup_state")) <= 4
    cols = roll.table().columns
    assert rows(roll.table().drop("ym")) == want and cols[-1] == "ym"
    assert roll.compact() and not roll.compact() and rows(roll.table().drop("ym")) == want
    assert roll.update(df.limit(0), 99) and rows(roll.table().drop("ym")) == want


def test_a_stream_of_events_keeps_its_rollup(spark):
    src, ck = scratch_dir(spark, "roll-src"), scratch_dir(spark, "roll-ck")
    roll = DailyRollup(spark, scratch_dir(spark, "roll-stream"), {"value": "value"})
    for k in range(2):
        events(spark, seed=k).write.mode("append").parquet(src)
        run_available(start_rollup_stream(roll, spark.readStream.schema(DDL).parquet(src), ck, {"availableNow": True}))
    want = rows(agg.daily_rollup_metrics(spark.read.schema(DDL).parquet(src), "ts", {"value": "value"}, "event_type", "user_id"))
    assert rows(roll.table().drop("ym")) == want
