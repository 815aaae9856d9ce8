"""The stored daily rollup (A08): state per day that adds up, updated per batch.

A batch is reduced to one row per (day, metric, dimension) with count, exact sum and bounds,
and to bitmaps of its users. Such rows merge by sum, extremes and bitwise or, so a batch only
adds its own small state; the table is the merge of what was added, distinct users included,
and equals the rollup of all events at once. Each batch is one commit, which also notes the
stream's batch number: a batch that comes again adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import year_month
from ..schemas import TABLES
from .commit_log import CommitConflict, CommitLog, Snapshot
from .write import stream_key, write_layout

KEY = ["dt", "metric_name", "dimension_key"]
STATE_DDL = "dt date, metric_name string, dimension_key string, n bigint, total decimal(38,2), low decimal(18,2), high decimal(18,2)"
USERS_DDL = "dt date, metric_name string, dimension_key string, part bigint, bits binary"
STATE, USERS, DONE = "rollup_state", "rollup_users", "done"


def batch_state(events: DataFrame, ts_col: str, metrics: dict[str, str], dim_col: str, user_col: str) -> tuple[DataFrame, DataFrame]:
    """(state, users) of a batch. A null value counts as an event and adds nothing to the sum;
    events without a user count, too. A null time or dimension is a key of its own."""
    long = events.select(F.to_date(ts_col).alias("dt"), F.col(dim_col).cast("string").alias("dimension_key"), F.col(user_col).cast("bigint").alias("user"),
                         *[F.col(c).cast("decimal(18,2)").alias(m) for m, c in metrics.items()])
    long = long.unpivot(["dt", "dimension_key", "user"], list(metrics), "metric_name", "value")
    state = long.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("decimal(38,2)").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    users = long.where("user is not null").groupBy(*KEY, F.bitmap_bucket_number("user").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("user")).alias("bits"))
    return state, users


def merge_state(state: DataFrame) -> DataFrame:
    return state.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,2)").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def merge_users(users: DataFrame) -> DataFrame:
    return users.groupBy(*KEY, "part").agg(F.bitmap_or_agg("bits").alias("bits"))


@dataclass
class DailyRollup:
    """The rollup of a stream of events, kept under ``root``."""
    spark: SparkSession
    root: str
    metrics: dict[str, str]     # metric name -> value column
    ts_col: str = "ts"
    dim_col: str = "event_type"
    user_col: str = "user_id"
    max_folders: int = 64

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.root)

    def update(self, events: DataFrame, batch_id: int, stream_id: str = "batch", retries: int = 3) -> bool:
        """Add a batch. False if this batch of the stream, or a later one, was added before."""
        state, users = batch_state(events, self.ts_col, self.metrics, self.dim_col, self.user_col)
        log = self.log
        slot, folder = log.new_folder(STATE)
        _, people = log.new_folder(USERS)
        wrote = False
        for attempt in range(retries + 1):
            at = log.snapshot()
            if int(at.slots(DONE).get(stream_id, -1)) >= batch_id:
                return False
            if not wrote:
                write_layout(state, folder, sort_by=("dt",))
                write_layout(users, people, sort_by=("dt",))
                wrote = True
            try:
                now = log.commit(at, add={STATE: {slot: folder}, USERS: {slot: people}, DONE: {stream_id: str(batch_id)}})
            except CommitConflict:   # another stream's batch: the states add up in any order
                if attempt == retries:
                    raise
                continue
            if len(now.slots(STATE)) > self.max_folders:
                self.compact(now)
            return True
        return False

    def compact(self, at: Snapshot | None = None) -> bool:
        """Merge all added states into one; False if another writer came first."""
        log = self.log
        at = at or log.snapshot()
        if len(at.slots(STATE)) < 2:
            return False
        slot, folder = log.new_folder(STATE)
        _, people = log.new_folder(USERS)
        write_layout(merge_state(log.read(STATE, STATE_DDL, at)), folder, sort_by=("dt", "metric_name"))
        write_layout(merge_users(log.read(USERS, USERS_DDL, at)), people, sort_by=("dt", "metric_name"))
        try:
            log.commit(at, replace={STATE: {slot: folder}, USERS: {slot: people}})
        except CommitConflict:
            return False
        return True

    def table(self, at: Snapshot | None = None) -> DataFrame:
        """``daily_aggregates`` with the types of the model."""
        at = at or self.log.snapshot()
        state = merge_state(self.log.read(STATE, STATE_DDL, at))
        users = merge_users(self.log.read(USERS, USERS_DDL, at)).groupBy(*KEY).agg(F.sum(F.bitmap_count("bits")).alias("users"))
        u = users.select(*[F.col(k).alias(f"u_{k}") for k in KEY], "users")
        same = F.col("dt").eqNullSafe(F.col("u_dt")) & (F.col("metric_name") == F.col("u_metric_name")) & F.col("dimension_key").eqNullSafe(F.col("u_dimension_key"))
        j = state.join(u, same, "left")
        out = j.select(*KEY, F.col("n").alias("total_count"), F.col("total").cast("double").alias("total_sum"), F.col("low").cast("double").alias("min_value"),
                       F.col("high").cast("double").alias("max_value"), (F.col("total").cast("double") / F.col("n")).alias("avg_value"),
                       F.coalesce("users", F.lit(0)).cast("bigint").alias("unique_users"), year_month(F.col("dt")).alias("ym"))
        spec = TABLES["analytics.daily_aggregates"]
        return out.select(*[F.col(f.name).cast(f.dataType) for f in spec.schema.fields])

    def store(self, path: str) -> None:
        """Write the table in its layout."""
        spec = TABLES["analytics.daily_aggregates"]
        write_layout(self.table(), path, partition_by=spec.partition_by, sort_by=spec.sort_by, bloom=spec.bloom)


def start_rollup_stream(rollup: DailyRollup, events: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Every micro-batch of an event stream is added to the rollup, once."""
    stream_id = stream_key(checkpoint)
    return (events.writeStream.foreachBatch(lambda df, n: rollup.update(df, n, stream_id) and None).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "10 seconds"})).start())
