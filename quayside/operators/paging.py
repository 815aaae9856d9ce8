"""State lookup (S05/J02/P03) and incremental page scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import SMALL_SIDE_ROWS, stage

PAGE_LIMIT = 1000  # fixed value: rows per trades page of the exchange API


def state_lookup(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """For every wanted ``(worker_type, symbol)`` its stored mark, or NULLs when there
    is none (an absent key is not an error). A left join on the composite key."""
    key = ["worker_type", "symbol"]
    s = state.select(*key, "last_id", "last_timestamp")
    return wanted.select(*key).join(s, on=key, how="left") \
                 .withColumn("has_state", F.col("last_id").isNotNull())


def incremental_page(trades: DataFrame, state: DataFrame, limit: int = PAGE_LIMIT,
                     worker_type: str = "agg_trades", salt_buckets: int = 64) -> DataFrame:
    """The next page per symbol: ids >= ``last_id + 1`` in id order, at most ``limit``;
    a symbol without state gets its newest ``limit`` rows.

    Top-k in two exact levels, so a symbol holding a third of all rows never lands in one
    task: first the top ``limit`` per (symbol, salt), the salt being the scan's partition
    number mod ``salt_buckets``, then the top ``limit`` per symbol over at most
    ``salt_buckets * limit`` survivors. Each ``row_number() <= limit`` is planned with a
    partial group limit before its shuffle (WindowGroupLimit); as a scan task meets one salt
    only, it sends at most ``limit`` rows per symbol. The marks are written first and
    broadcast if their counted rows allow; beyond that the join deals the trades by symbol."""
    marks = stage(state.filter(F.col("worker_type") == worker_type).select("symbol", "last_id"), "page-marks")
    if marks.count() <= SMALL_SIDE_ROWS:
        marks = F.broadcast(marks)
    j = trades.join(marks, on="symbol", how="left")
    j = j.filter(F.col("last_id").isNull() | (F.col("agg_trade_id") >= F.col("last_id") + 1))
    order = F.when(F.col("last_id").isNull(), -F.col("agg_trade_id")).otherwise(F.col("agg_trade_id"))
    salted = j.withColumn("_salt", F.spark_partition_id() % salt_buckets)
    w1 = Window.partitionBy("symbol", "_salt").orderBy(order)
    first = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= limit).drop("_r", "_salt")
    w2 = Window.partitionBy("symbol").orderBy(order)
    return first.withColumn("page_row", F.row_number().over(w2)).filter(F.col("page_row") <= limit) \
                .withColumn("from_state", F.col("last_id").isNotNull()).drop("last_id")
