"""Aggregations A01-A10 and the running-window snapshot W01.

All aggregates here are planned as partial/final aggregates (map-side combine: hash
based, or sort based for ``min_by``/``max_by`` over struct keys), so a key holding a
third of the rows is reduced inside every map task before the shuffle.
Order-dependent picks (open/last price, entry/exit URL) use ``min_by``/``max_by``
over an explicit total order, never the row order of a DataFrame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import exact_difference, exact_product, ts_to_millis
from ..session import SMALL_SIDE_ROWS, stage


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- A01-A04

def grouped_count(df: DataFrame, key: str, name: str = "cnt") -> DataFrame:
    """A02 + O01: ``SELECT count(*) AS cnt, key ... GROUP BY key ORDER BY key``."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).select(name, key).orderBy(key)


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """``count(*)`` of every table, one row each (UNION ALL of one-row aggregates)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def side_counts(levels: DataFrame) -> DataFrame:
    """Both filtered counts in one pass."""
    return levels.agg(F.count_if(F.col("side") == "bid").alias("bid_levels"),
                      F.count_if(F.col("side") == "ask").alias("ask_levels"))


def distinct_count(df: DataFrame, col: str, name: str) -> DataFrame:
    """Exact ``COUNT(DISTINCT col)`` (dedup per partition, shuffle distinct values only)."""
    return df.agg(F.count_distinct(col).alias(name))


# --------------------------------------------------------------------------- A08

def daily_rollup(df: DataFrame, ts_col: str, value_col: str, dim_col: str, user_col: str,
                 metric: str, value_type: str = "decimal(18,2)") -> DataFrame:
    """Per (day, metric, dimension): count, exact sum (then double), min, max, avg =
    sum / count, exact distinct users."""
    v = _c(value_col).cast(value_type)
    g = df.groupBy(F.to_date(ts_col).alias("dt"), F.lit(metric).alias("metric_name"),
                   _c(dim_col).alias("dimension_key"))
    out = g.agg(F.count(F.lit(1)).alias("total_count"), F.sum(v).alias("_sum"),
                F.min(v).alias("_min"), F.max(v).alias("_max"), F.count_distinct(user_col).alias("unique_users"))
    return out.select(
        "dt", "metric_name", "dimension_key", "total_count",
        F.col("_sum").cast("double").alias("total_sum"),
        F.col("_min").cast("double").alias("min_value"), F.col("_max").cast("double").alias("max_value"),
        (F.col("_sum").cast("double") / F.col("total_count")).alias("avg_value"),
        "unique_users")


def daily_rollup_metrics(df: DataFrame, ts_col: str, metrics: dict[str, str], dim_col: str, user_col: str,
                         value_type: str = "decimal(18,2)") -> DataFrame:
    """A08 for several metrics in one pass: the metric columns are unpivoted into
    (metric_name, value) rows, then one aggregate keyed by (day, metric, dimension)."""
    names = list(metrics)
    base = df.select(F.col(ts_col).alias("_ts"), F.col(dim_col).alias("_dim"), F.col(user_col).alias("_user"),
                     *[F.col(c).cast(value_type).alias(n) for n, c in metrics.items()])
    long = base.unpivot(["_ts", "_dim", "_user"], names, "_metric", "_value")
    g = long.groupBy(F.to_date("_ts").alias("dt"), F.col("_metric").alias("metric_name"),
                     F.col("_dim").alias("dimension_key"))
    out = g.agg(F.count(F.lit(1)).alias("total_count"), F.sum("_value").alias("_sum"),
                F.min("_value").alias("_min"), F.max("_value").alias("_max"),
                F.count_distinct("_user").alias("unique_users"))
    return out.select(
        "dt", "metric_name", "dimension_key", "total_count",
        F.col("_sum").cast("double").alias("total_sum"),
        F.col("_min").cast("double").alias("min_value"), F.col("_max").cast("double").alias("max_value"),
        (F.col("_sum").cast("double") / F.col("total_count")).alias("avg_value"),
        "unique_users")


# --------------------------------------------------------------------------- A09 sessions

def sessionize(df: DataFrame, user_col: str, ts_col: str, id_col: str, gap_seconds: int,
               bucket_seconds: int = 3600, out_col: str = "session_no") -> DataFrame:
    """Gap sessions: a new session starts when the gap to the user's previous event
    (order ``ts, id``) exceeds ``gap_seconds``. Adds ``out_col`` = 1, 2, ... per user.

    Scales with a hot user: rows are sessionized inside (user, time bucket) groups in
    parallel; a small per-(user, bucket) summary is then stitched per user (a session
    continues across a bucket edge iff the gap across the edge is small enough), and
    the offsets are joined back. No task ever holds all events of one user.

    An event without a time cannot be placed: each is a session of its own, numbered before
    the user's others. Events without a user form the sessions of a null user. Where only facts
    per session are wanted, :func:`gap_session_facts` needs no row-level window at all."""
    gap_us = F.lit(gap_seconds * 1_000_000)
    ts = F.col(ts_col)
    rows = df.withColumn("_b", F.floor(ts_to_millis(ts) / F.lit(bucket_seconds * 1000)))
    w_in = Window.partitionBy(user_col, "_b").orderBy(ts_col, id_col)
    prev = F.lag(ts_col).over(w_in)
    rows = rows.withColumn("_new", F.when(prev.isNull() | (F.timestamp_diff("MICROSECOND", prev, ts) > gap_us), 1)
                           .otherwise(0))
    rows = rows.withColumn("_local", F.sum("_new").over(w_in.rowsBetween(Window.unboundedPreceding, 0)))
    summ = rows.groupBy(user_col, "_b").agg(F.min(ts_col).alias("_first"), F.max(ts_col).alias("_last"),
                                            F.max("_local").alias("_n"))
    w_u = Window.partitionBy(user_col).orderBy("_b")
    prev_last = F.lag("_last").over(w_u)
    summ = summ.withColumn(
        "_starts", F.when(prev_last.isNull() | (F.timestamp_diff("MICROSECOND", prev_last, F.col("_first")) > gap_us),
                          1).otherwise(0))
    summ = summ.withColumn("_born", F.col("_n") - (1 - F.col("_starts")))
    summ = summ.withColumn("_base", F.coalesce(F.sum("_born").over(w_u.rowsBetween(Window.unboundedPreceding, -1)),
                                               F.lit(0)))
    summ = summ.select(F.col(user_col).alias("_user"), F.col("_b").alias("_bucket"),
                       (F.col("_base") - (1 - F.col("_starts"))).alias("_offset"))
    # null-safe: events without a user form sessions of their own
    out = rows.join(summ, rows[user_col].eqNullSafe(F.col("_user")) & F.col("_b").eqNullSafe(F.col("_bucket")))
    return out.withColumn(out_col, (F.col("_offset") + F.col("_local")).cast("bigint")) \
              .drop("_b", "_new", "_local", "_offset", "_user", "_bucket")


def gap_session_facts(events: DataFrame, gap_seconds: int, user_col: str = "user_id", ts_col: str = "event_timestamp",
                      id_col: str = "event_id", url_col: str = "page_url", duration_col: str = "duration_seconds",
                      device_col: str = "device_type", cells_per_block: int = 4096) -> DataFrame:
    """A09 in one pass over the events: gap sessions and their facts.

    Time is cut into cells no longer than the gap, so no session ends inside a cell. Events are
    reduced to one row of facts per (user, cell) before the shuffle: a user with a third of
    all events in one hour leaves every task as a few rows. A cell opens a session if the time
    since the cell before exceeds the gap; cells are numbered inside blocks of ``cells_per_block``
    and block summaries carry last time and count over the borders, so a user with very many
    cells is spread, too. Facts of a session's cells then merge.

    Events without a time form one session of their user, numbered first; events without a
    user the sessions of a null user. Of events that tie on (time, id) the smallest entry."""
    gap_us = max(1, gap_seconds * 1_000_000)
    ts, user = F.col(ts_col), F.col(user_col)
    first, last = F.struct(ts_col, id_col, F.col(url_col).alias("url"), F.col(device_col).alias("device")), F.struct(ts_col, id_col, F.col(url_col).alias("url"))
    cells = events.groupBy(user.alias("u"), F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) / F.lit(gap_us)).alias("cell")).agg(
        F.min(ts_col).alias("t0"), F.max(ts_col).alias("t1"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col(duration_col).cast("decimal(18,2)")).alias("spent"), F.min(first).alias("entry"), F.max(last).alias("exit"))
    cells = stage(cells.withColumn("block", F.floor(F.col("cell") / F.lit(cells_per_block))), "session-cells")

    def opens(previous: Column, t0: Column) -> Column:
        return F.when(previous.isNull() | (F.timestamp_diff("MICROSECOND", previous, t0) > F.lit(gap_seconds * 1_000_000)), 1).otherwise(0)

    inside = Window.partitionBy("u", "block").orderBy("cell")
    before = F.lag("t1").over(inside)
    numbered = cells.withColumn("opens", F.when(F.row_number().over(inside) == 1, 0).otherwise(opens(before, F.col("t0"))))
    numbered = numbered.withColumn("local", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = numbered.groupBy("u", "block").agg(F.min("t0").alias("b0"), F.max("t1").alias("b1"), F.sum("opens").alias("within"))
    along = Window.partitionBy("u").orderBy("block")
    blocks = blocks.withColumn("first_opens", opens(F.lag("b1").over(along), F.col("b0")))
    earlier = F.sum(F.col("within") + F.col("first_opens")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("u").alias("b_u"), F.col("block").alias("b_block"), (F.coalesce(earlier, F.lit(0)) + F.col("first_opens")).alias("base"))
    same = F.col("u").eqNullSafe(F.col("b_u")) & F.col("block").eqNullSafe(F.col("b_block"))
    sessions = numbered.join(blocks, same).groupBy("u", (F.col("base") + F.col("local")).cast("bigint").alias("session_no")).agg(
        F.min("t0").alias("started_at"), F.max("t1").alias("ended_at"), F.sum("n").alias("page_count"), F.sum("spent").alias("spent"),
        F.min("entry").alias("entry"), F.max("exit").alias("exit"))
    return sessions.select(
        F.concat_ws("-", F.col("u").cast("string"), F.col("session_no").cast("string")).alias("session_id"), F.col("u").alias(user_col), "session_no",
        "started_at", "ended_at", "page_count", F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at")).alias("session_seconds"),
        F.col("spent").cast("double").alias("total_duration_seconds"), (F.col("page_count") == 1).alias("is_bounce"),
        F.col("entry.url").alias("entry_url"), F.col("exit.url").alias("exit_url"), F.col("entry.device").alias("device_type"))


def session_facts(events: DataFrame, user_col: str = "user_id", session_col: str = "session_no",
                  ts_col: str = "event_timestamp", id_col: str = "event_id", url_col: str = "page_url",
                  duration_col: str = "duration_seconds", device_col: str = "device_type") -> DataFrame:
    """One row per session: start, end, page count, durations, bounce flag, entry /
    exit URL and device by ``(ts, id)``."""
    order = F.struct(ts_col, id_col)
    out = events.groupBy(user_col, session_col).agg(
        F.min(ts_col).alias("started_at"), F.max(ts_col).alias("ended_at"),
        F.count(F.lit(1)).alias("page_count"),
        F.sum(F.col(duration_col).cast("decimal(18,2)")).cast("double").alias("total_duration_seconds"),
        F.min_by(url_col, order).alias("entry_url"), F.max_by(url_col, order).alias("exit_url"),
        F.min_by(device_col, order).alias("device_type"))
    if session_col == "session_id":          # real input: the table's own session id
        ident = [F.col("session_id"), F.col(user_col)]
    else:                                    # derived sessions: numbered per user
        ident = [F.concat_ws("-", F.col(user_col).cast("string"), F.col(session_col).cast("string"))
                 .alias("session_id"), F.col(user_col), F.col(session_col)]
    return out.select(
        *ident, "started_at", "ended_at", "page_count",
        F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at")).alias("session_seconds"),
        "total_duration_seconds", (F.col("page_count") == 1).alias("is_bounce"),
        "entry_url", "exit_url", "device_type")


# --------------------------------------------------------------------------- A10 ticker

def ticker_from_trades(trades: DataFrame, window_hours: int = 24, since=None) -> DataFrame:
    """A10: 24-hour statistics per symbol over (max time - 24 h, max time].

    The end time per symbol is written first (one row per symbol) and broadcast if its counted
    rows allow, so that trades are not dealt by symbol; the earliest window start filters
    the second scan. The statistics are one partial/final aggregate. ``since`` (optional) is a
    lower bound on trade time known to lie before every symbol's window, e.g. now - 48 h
    on a live table: it also bounds the scan for the end times.

    Prices and quantities are ``decimal(38,18)``. ``quote_volume_exact`` tells whether every
    product was exact; one that needs more digits is rounded to 6 decimals, and a sum beyond
    the type is NULL."""
    if since is not None:
        trades = trades.filter(F.col("trade_time") >= F.lit(since).cast("timestamp_ntz"))
    end = stage(trades.groupBy("symbol").agg(F.max("trade_time").alias("_end")), "ticker-ends")
    size = end.agg(F.count(F.lit(1)).alias("n"), F.min("_end").alias("first")).first()
    if size["first"] is not None:
        first = F.timestamp_add("HOUR", F.lit(-window_hours), F.lit(size["first"]).cast("timestamp_ntz"))
        trades = trades.filter(F.col("trade_time") > first)
    if size["n"] <= SMALL_SIDE_ROWS:
        end = F.broadcast(end)
    start = F.timestamp_add("HOUR", F.lit(-window_hours), F.col("_end"))
    w = trades.join(end, "symbol").filter(F.col("trade_time") > start)
    order = F.struct("trade_time", "agg_trade_id")
    exact = exact_product("price", "quantity")
    rounded = F.try_multiply(F.col("price"), F.col("quantity")).try_cast("decimal(38,18)")
    w = w.withColumns({"_exact": exact, "_rounded": rounded})
    a = w.groupBy("symbol").agg(
        F.min_by("price", order).alias("open_price"), F.max_by("price", order).alias("last_price"),
        F.max_by("quantity", order).alias("last_qty"),
        F.max("price").alias("high_price"), F.min("price").alias("low_price"),
        F.try_sum("quantity").alias("volume"), F.try_sum(F.coalesce("_exact", "_rounded")).alias("quote_volume"),
        F.bool_and(F.col("_exact").isNotNull()).alias("_all_exact"),
        F.min("trade_time").alias("open_time"), F.max("trade_time").alias("close_time"),
        F.min_by("agg_trade_id", order).alias("first_trade_id"),
        F.max_by("agg_trade_id", order).alias("last_trade_id"),
        F.sum(F.col("last_trade_id") - F.col("first_trade_id") + 1).alias("trade_count"),
        F.count(F.lit(1)).alias("agg_trade_rows"))
    change = exact_difference("last_price", "open_price")
    return a.select(
        "symbol", change.alias("price_change"),
        F.round(F.lit(100.0) * change.cast("double") / F.col("open_price").cast("double"), 3)
         .alias("price_change_pct"),
        F.round(F.col("quote_volume").cast("double") / F.col("volume").cast("double"), 6).alias("weighted_avg"),
        "last_price", "last_qty", "open_price", "high_price", "low_price", "volume", "quote_volume",
        "open_time", "close_time", "first_trade_id", "last_trade_id",
        F.col("trade_count").cast("bigint").alias("trade_count"), "agg_trade_rows",
        (F.col("_all_exact") & F.col("quote_volume").isNotNull()).alias("quote_volume_exact"))


# --------------------------------------------------------------------------- W01 stock

def stock_snapshot(movements: DataFrame, reserved: int = 0, reorder_point: int = 0,
                   stock_levels: DataFrame | None = None) -> DataFrame:
    """On-hand stock per (day, warehouse, product) from signed movements.

    Movements are first summed per day (partial aggregate), so the running window sees
    one row per (product, warehouse, day with a movement): bounded by the number of
    days, however many movements a hot product has. Reserved quantity and reorder point
    are the scalars given, or per (warehouse, product) from ``stock_levels``
    (``warehouse_id, product_id, quantity_reserved, reorder_point``), joined on the key
    the window already partitions by."""
    daily = movements.groupBy(F.to_date("movement_timestamp").alias("snapshot_date"), "warehouse_id",
                              "product_id").agg(
        F.sum("quantity").alias("_net"), F.max(F.col("quantity") > 0).alias("_inbound"))
    # product first: Spark sorts on a prefix of the first column, and warehouses are few
    w = Window.partitionBy("product_id", "warehouse_id").orderBy("snapshot_date") \
              .rowsBetween(Window.unboundedPreceding, 0)
    snap = daily.select(
        "snapshot_date", "warehouse_id", "product_id",
        F.sum("_net").over(w).cast("bigint").alias("quantity_on_hand"),
        F.max(F.when(F.col("_inbound"), F.col("snapshot_date"))).over(w).alias("last_restock_date"))
    if stock_levels is not None:
        lv = stock_levels.select("warehouse_id", "product_id",
                                 F.col("quantity_reserved").cast("bigint").alias("_res"),
                                 F.col("reorder_point").cast("bigint").alias("_rop"))
        snap = snap.join(lv, on=["warehouse_id", "product_id"], how="left")
        res = F.coalesce(F.col("_res"), F.lit(reserved).cast("bigint"))
        rop = F.coalesce(F.col("_rop"), F.lit(reorder_point).cast("bigint"))
    else:
        res, rop = F.lit(reserved).cast("bigint"), F.lit(reorder_point).cast("bigint")
    return snap.select(
        "snapshot_date", "warehouse_id", "product_id", "quantity_on_hand",
        res.alias("quantity_reserved"), (F.col("quantity_on_hand") - res).alias("quantity_available"),
        "last_restock_date", rop.alias("reorder_point"))
