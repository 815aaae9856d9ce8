"""Query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per driver query.

Each query reads the driver tables (through the stand-ins of ``standins``) in full and
runs the library's operators on them. Queries that exercise a write or a stream
write to a fresh folder under the session's shared checkpoint directory and return
the read-back result.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql_udf import register_factorial
from ..functions.text import quote_join, replace_first, replace_within, split_clean
from ..operators import aggregates as agg
from ..operators import paging, quality, telemetry
from ..operators.decode import (book_sizes, cut_levels, decode_agg_trades, decode_events, decode_order_book, decode_symbols, decode_ticker,
                                numbered_responses)
from ..operators.encode import event_messages
from ..operators.ingest import TradeStore, ingest_trade_pages
from ..operators.rollup import DailyRollup
from ..operators.skip_index import build_skip_index, read_matching
from ..operators.snapshots import StockSnapshots
from ..operators.write import (VersionedTable, add_month, bootstrap, high_water_marks, insert_ignore,
                               month_filter, observed_append, replace_table, upsert, write_bucketed, write_layout,
                               write_shards,
                               write_table)
from ..schemas import EVENT_MESSAGE_DDL, EVENT_MESSAGE_FIELDS, PRICE, TABLES
from ..session import scratch_dir, stage
from ..sources.tables import DRIVER_TABLES, ShardedTable, read_json, read_shards, table
from ..streaming.events import decode_event_stream, events_to_json_files, file_messages, run_available
from ..streaming.market import start_book_stream, start_ticker_stream
from ..streaming.trades import response_stream, start_deduplicated_trade_stream, start_trade_stream, state_report
from . import standins as si

BOOK_DEPTH = 20         # fixed value: requested book depth of the reference
TOP_LEVELS = 3          # levels a side that the top-of-book query reads (cuts books of 4 bids)
SESSION_GAP_S = 8 * 3600
REPEAT_FROM = "2024-01-20"   # pages fetched from then on are delivered twice


# --------------------------------------------------------------------------- lake path

def events_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """A02 + O01, the flagship: grouped count of events by type, ordered by type."""
    return agg.grouped_count(table(spark, sf, "events"), "event_type")


def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Row count of every driver table."""
    return agg.table_counts({t: table(spark, sf, t) for t in DRIVER_TABLES})


def events_projection(spark: SparkSession, sf: str) -> DataFrame:
    """The 5-column projection of the event table."""
    return si.app_events(spark, sf).select("event_id", "user_id", "event_type", "payload", "created_at")


def _message_dir(spark: SparkSession, sf: str, name: str) -> str:
    """Write the event messages (K04) as text lines to a fresh folder, one file per input
    split (the input's own parallelism; nothing is funnelled into a fixed task count)."""
    path = scratch_dir(spark, name)
    event_messages(si.app_events(spark, sf)).write.text(path)
    return path


def json_scan_infer(spark: SparkSession, sf: str) -> DataFrame:
    """Messages written as JSON files, read back with an inferred schema."""
    path = _message_dir(spark, sf, "json-scan")
    df = read_json(spark, path)
    return df.select("event_id", "user_id", "event_type", "payload", "created_at")


def top_n(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 largest event values under a total order (top-k, no full sort)."""
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", "event_type", "value") \
            .orderBy(F.col("value").desc(), F.col("event_id").asc()).limit(100)


def predicate_mix(spark: SparkSession, sf: str) -> DataFrame:
    """P04-P06 + O02: escaped NOT LIKE, IN, NOT IN, NOT starts-with; multi-key order."""
    p = table(spark, sf, "part")
    cond = (~F.col("p_name").like("red\\_%")
            & F.col("p_type").isin("ECONOMY", "SMALL", "STANDARD", "LARGE")
            & ~F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")
            & ~F.col("p_name").startswith("blue"))
    return p.filter(cond).select("p_partkey", "p_name", "p_brand", "p_type", "p_size") \
            .orderBy("p_brand", "p_size", "p_partkey")


def include_exclude(spark: SparkSession, sf: str) -> DataFrame:
    """Include list then exclude list, both comma-separated with blanks."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return quality.include_exclude(e, "event_type", " click, view ,purchase,signup ", "view , signup")


def time_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    """User events written month-partitioned and sorted by (user, time), then one
    user's events in a time span read back with partition and row-group pruning."""
    spec = TABLES["analytics.user_events"]
    path = scratch_dir(spark, "user-events")
    ue = add_month(si.user_events(spark, sf), "event_timestamp")
    write_table(ue.select(*[c for c in ue.columns if c != "device_type"]), path, spec)
    back = spark.read.parquet(path)
    return back.filter((F.col("user_id") == 7)
                       & month_filter("event_timestamp", "2024-01-05 00:00:00", "2024-01-20 00:00:00")) \
               .select("event_id", "user_id", "event_type", "event_timestamp", "page_url")


INDEXES = {   # the model's skip indexes: column, kind, size
    "user_events": {"event_type": ("set", 100), "country_code": ("bloom", 1 << 15)},
    "daily_aggregates": {"dimension_key": ("bloom", 1 << 20)},
    "session_facts": {"total_duration_seconds": ("minmax",)},
    "products": {"sku": ("bloom", 1 << 20), "price": ("minmax",)},
    "stock_movements": {"warehouse_id": ("set", 50)},
    "warehouse_snapshots": {"quantity_available": ("minmax",)},
}


def _model_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the six tables of the warehouse model."""
    if name == "user_events":
        return add_month(si.user_events(spark, sf), "event_timestamp")
    if name == "daily_aggregates":
        return add_month(daily_rollup(spark, sf), "dt")
    if name == "session_facts":
        return add_month(agg.gap_session_facts(si.user_events(spark, sf), SESSION_GAP_S), "started_at")
    if name == "products":
        return si.products(spark, sf)
    if name == "stock_movements":
        return add_month(si.stock_movements(spark, sf), "movement_timestamp")
    return add_month(agg.stock_snapshot(si.stock_movements(spark, sf)), "snapshot_date")


STORED_FIRST = ("daily_aggregates", "session_facts")   # much smaller than their events, and read twice when they are dealt


def _model_keys(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Snapshots have one row per (day, warehouse, product) with a movement: their keys are
    known from the movements alone."""
    day = F.to_date("movement_timestamp").alias("snapshot_date")
    return {"warehouse_snapshots": add_month(si.stock_movements(spark, sf).select(day, "warehouse_id", "product_id"), "snapshot_date")}


def _spec(name: str):
    return next(t for t in TABLES.values() if t.name == name)


def index_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Every index-shaped predicate over tables written in their layouts with a skip
    index beside them, as counts per predicate; files are chosen on the index first."""
    keys, roots = _model_keys(spark, sf), {}
    for name in INDEXES:
        spec, df = _spec(name), _model_table(spark, sf, name)
        df = stage(df, name) if name in STORED_FIRST else df
        roots[name] = scratch_dir(spark, name)
        write_layout(df, roots[name], partition_by=spec.partition_by, sort_by=spec.sort_by, bloom=spec.bloom, keys=keys.get(name))
        build_skip_index(spark, roots[name], f"{roots[name]}_index", INDEXES[name])
    price = [Decimal(950), Decimal(1500)]
    asked = [
        ("sku_eq", "products", [("eq", "sku", "SKU-42")]),
        ("category_eq_price_range", "products", [("eq", "category", "Brand#4"), ("between", "price", *price)]),
        ("active_only", "products", [("eq", "is_active", 1)]),
        ("warehouse_in", "stock_movements", [("in", "warehouse_id", [1, 2, 3])]),
        ("outbound_qty_le", "stock_movements", [("eq", "movement_type", "outbound"), ("le", "quantity", -40)]),
        ("event_type_in", "user_events", [("in", "event_type", ["click", "purchase"])]),
        ("country_eq", "user_events", [("eq", "country_code", "DE")]),
        ("dimension_eq", "daily_aggregates", [("eq", "dimension_key", "click")]),
        ("duration_range", "session_facts", [("between", "total_duration_seconds", 100.0, 500.0)]),
        ("available_le", "warehouse_snapshots", [("le", "quantity_available", 0)]),
    ]
    parts = {k: read_matching(spark, roots[t], f"{roots[t]}_index", INDEXES[t], p) for k, t, p in asked}
    return agg.table_counts(parts).withColumnRenamed("table_name", "predicate").withColumnRenamed("row_count", "matches")


def partitioned_write_read(spark: SparkSession, sf: str) -> DataFrame:
    """Stock movements round-tripped through the month layout; counts per month."""
    spec = TABLES["inventory.stock_movements"]
    path = scratch_dir(spark, "movements-ym")
    write_layout(add_month(si.stock_movements(spark, sf), "movement_timestamp"), path,
                 partition_by=spec.partition_by, sort_by=spec.sort_by)
    back = spark.read.parquet(path)
    return back.groupBy("ym").agg(F.count(F.lit(1)).alias("movements"),
                                  F.sum("quantity").cast("bigint").alias("net_quantity"))


def sharded_read_count(spark: SparkSession, sf: str) -> DataFrame:
    """K17 + S07: hash-sharded write into 2 shards, facade read of all shards."""
    root = scratch_dir(spark, "shards")
    paths = write_shards(si.user_events(spark, sf), root, ["event_id"], 2)
    facade = read_shards(spark, paths)
    return facade.agg(F.count(F.lit(1)).alias("row_count"), F.sum("event_id").cast("bigint").alias("sum_event_id"))


SHARD_KEYS = {   # key of each sharded table, and the key that is looked up
    "user_events": (("user_id",), (7,)),
    "daily_aggregates": (("dimension_key",), ("click",)),
    "session_facts": (("user_id",), (7,)),
    "products": (("product_id",), (42,)),
    "stock_movements": (("product_id",), (42,)),
    "warehouse_snapshots": (("warehouse_id", "product_id"), (3, 42)),
}


def sharded_tables(spark: SparkSession, sf: str) -> DataFrame:
    """K17 + S07 for all six tables of the model: dealt to 2 shards by key; rows of the facade,
    rows of one key (one shard is read), and rows of the keys of small accounts or products."""
    some = {"user_id": table(spark, sf, "events").where("user_id < 5").select("user_id"),
            "product_id": table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("product_id"))}
    keys = _model_keys(spark, sf)

    def counted(name: str) -> list[DataFrame]:
        (key, value), df = SHARD_KEYS[name], _model_table(spark, sf, name)
        t = ShardedTable(spark, scratch_dir(spark, f"sharded-{name}"), _spec(name), key, 2)
        t.write(stage(df, name) if name in STORED_FIRST else df, keys=keys.get(name))
        asked = {"rows": t.read(), "rows_of_key": t.lookup(*value)}
        if key[0] in some:
            asked["rows_of_keys"] = t.join_keys(some[key[0]])
        return [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.lit(k).alias("read"), "n") for k, p in asked.items()]

    # the tables do not depend on each other: while one is counted or committed, or on its last tasks, others run
    with ThreadPoolExecutor(len(SHARD_KEYS)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(partial(counted, name))) for name in SHARD_KEYS]
        counts = [c for job in jobs for c in job.result()]
    return reduce(DataFrame.unionByName, counts)


# --------------------------------------------------------------------------- book

def _book(spark: SparkSession, sf: str, depth: int):
    return decode_order_book(numbered_responses(si.order_books(spark, sf, depth), "books"))


def side_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bid and ask level counts in one pass (reference depth 20)."""
    return agg.side_counts(_book(spark, sf, 20).levels)


def distinct_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Exact distinct symbol counts of trades and of books."""
    t = agg.distinct_count(si.agg_trades(spark, sf), "symbol", "n_symbols").select(
        F.lit("agg_trades").alias("table_name"), "n_symbols")
    b = agg.distinct_count(_book(spark, sf, 20).headers, "symbol", "n_symbols").select(
        F.lit("orderbook_snapshots").alias("table_name"), "n_symbols")
    return t.unionByName(b)


def orderbook_headers(spark: SparkSession, sf: str) -> DataFrame:
    """K10 header side: one snapshot per book response (natural key shown)."""
    return _book(spark, sf, BOOK_DEPTH).headers.select("symbol", "last_update_id", "depth_level")


def orderbook_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Usable levels, indexes after the drop, the best ``TOP_LEVELS`` read of each side."""
    return cut_levels(_book(spark, sf, BOOK_DEPTH).levels, TOP_LEVELS).select(
        "symbol", "last_update_id", "side", "level_index", "price", "quantity")


def _bucket_count(spark: SparkSession) -> int:
    """Buckets follow the session's shuffle parallelism (sized by the cluster for its data)."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def book_with_header(spark: SparkSession, sf: str) -> DataFrame:
    """Levels joined to their snapshot header on ``snapshot_id``. Both tables are stored
    bucketed on ``snapshot_id`` with the same bucket count, so the join reads matching
    buckets side by side: no shuffle of either table."""
    root = scratch_dir(spark, "book")
    db = "q" + root.rsplit("-", 1)[-1] + "_book"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{root}/db'")
    b = _book(spark, sf, BOOK_DEPTH)
    n = _bucket_count(spark)
    write_bucketed(b.headers, f"{db}.snapshots", f"{root}/snapshots", n, ("snapshot_id",))
    write_bucketed(b.levels.drop("symbol", "last_update_id"), f"{db}.levels", f"{root}/levels", n,
                   ("snapshot_id",))
    j = spark.table(f"{db}.levels").join(spark.table(f"{db}.snapshots"), on="snapshot_id", how="inner")
    return j.select("symbol", "last_update_id", "depth_level", "side", "level_index", "price", "quantity")


def stream_books(spark: SparkSession, sf: str) -> DataFrame:
    """T04 + K10 in a stream: book responses arrive as files; every micro-batch writes
    snapshot headers and levels (idempotently per batch id); the stored levels are read
    back."""
    src, ck, root = (scratch_dir(spark, n) for n in ("books-src", "books-ck", "books-store"))
    si.order_books(spark, sf, BOOK_DEPTH).write.json(src)
    q = start_book_stream(root, response_stream(spark, src, max_files_per_trigger=8), ck,
                          trigger={"availableNow": True})
    run_available(q)
    lv = spark.read.parquet(f"{root}/orderbook_levels").drop("stream_id", "batch_id")
    return lv.select("symbol", "last_update_id", "side", "level_index", "price", "quantity")


def market_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """K12 for books and tickers: rows written per symbol, as each stream counts them."""
    roots = {}
    for name, responses, start in (("book", si.order_books(spark, sf, BOOK_DEPTH), start_book_stream),
                                   ("ticker", si.ticker_responses(agg.ticker_from_trades(si.agg_trades(spark, sf))), start_ticker_stream)):
        src, ck, roots[name] = (scratch_dir(spark, f"{name}-{n}") for n in ("counts-src", "counts-ck", "counts-store"))
        responses.write.json(src)
        run_available(start(roots[name], response_stream(spark, src, max_files_per_trigger=3), ck, trigger={"availableNow": True}))
    book = spark.read.parquet(f"{roots['book']}/orderbook_metrics").groupBy("symbol").agg(F.sum("snapshots").alias("snapshots"), F.sum("levels").alias("levels"))
    tick = spark.read.parquet(f"{roots['ticker']}/ticker_metrics").groupBy("symbol").agg(F.sum("tickers").alias("tickers"))
    zero = F.lit(0).cast("bigint")
    return book.withColumn("tickers", zero).unionByName(tick.select("symbol", zero.alias("snapshots"), zero.alias("levels"), "tickers"))


# --------------------------------------------------------------------------- quality

def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """The verification script's thresholds over the stand-in market tables; every
    body is parsed once, by the one aggregate that serves all checks on its source."""
    symbols = decode_symbols(si.exchange_info(spark, sf)).good
    trades = decode_agg_trades(si.trade_pages(spark, sf)).good
    books = book_sizes(si.order_books(spark, sf, 20))
    ticker = decode_ticker(si.ticker_responses(agg.ticker_from_trades(si.agg_trades(spark, sf)))).good
    one = F.count(F.lit(1))
    sym = symbols.agg(one.alias("n"))
    # a mark is kept for every symbol with a trade
    traded = trades.groupBy("symbol").agg(one.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), one.alias("marks"))
    book = books.agg(one.alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bid", "ask")])
    book = book.withColumn("levels", F.col("bid") + F.col("ask"))
    tick = ticker.agg(one.alias("n"), F.count_distinct("symbol").alias("symbols"))
    checks = [
        ("symbols", sym, "n", 3), ("agg_trades", traded, "n", 1),
        ("orderbook_snapshots", book, "n", 1), ("orderbook_levels", book, "levels", 1),
        ("ticker_24hr", tick, "n", 1), ("ingest_state", traded, "marks", 1),
        ("bid_levels", book, "bid", 1), ("ask_levels", book, "ask", 1),
        ("ticker_symbols", tick, "symbols", 3),
    ]
    return quality.threshold_report(checks)


def constraint_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rule violations of the seven tables on dirtied stand-ins: every NOT NULL column,
    length <= 64, unique keys, allowed sides, and levels whose order has no header (orphans)."""
    spec = {n: TABLES[f"crypto.{n}"] for n in ("symbols", "agg_trades", "orderbook_snapshots", "orderbook_levels", "ticker_24hr", "ingest_state")}
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    out = [quality.validate_spec(si.dirty_app_events(spark, sf), TABLES["app.events"])]
    symbols = keep_last_symbols(decode_symbols(si.exchange_info(spark, sf)).good)
    out.append(quality.validate_spec(si.planted(symbols, spec["symbols"]), spec["symbols"]))
    stored = si.agg_trades(spark, sf).withColumn("inserted_at", now)
    out.append(quality.validate_spec(si.planted(stored, spec["agg_trades"], "agg_trade_id"), spec["agg_trades"]))
    decoded = _book(spark, sf, 20)   # stored once: the rules pass each table two or three times
    book = decoded._replace(headers=stage(decoded.headers, "headers"), levels=stage(decoded.levels, "levels"))
    out.append(quality.validate_spec(si.planted(book.headers, spec["orderbook_snapshots"], "last_update_id"), spec["orderbook_snapshots"]))
    # dirtied parent: the header write "failed" for books fetched from HEADER_GAP_FROM on,
    # so their levels have no header (matched on snapshot_id only)
    headers = book.headers.filter(F.col("snapshot_time") < F.lit(HEADER_GAP_FROM).cast("timestamp_ntz"))
    levels = si.planted(book.levels, spec["orderbook_levels"], "last_update_id")
    levels = levels.withColumn("side", F.when(F.col("last_update_id") % 101 == 2, F.concat("side", F.lit("?"))).otherwise(F.col("side")))
    out.append(quality.validate_spec(levels, spec["orderbook_levels"], headers, ("snapshot_id",)))
    ticker = decode_ticker(numbered_responses(si.ticker_responses(agg.ticker_from_trades(si.agg_trades(spark, sf))))).good
    out.append(quality.validate_spec(si.planted(ticker, spec["ticker_24hr"]), spec["ticker_24hr"]))
    marks = high_water_marks(stored)
    out.append(quality.validate_spec(si.planted(marks, spec["ingest_state"]), spec["ingest_state"]))
    return reduce(DataFrame.unionByName, out)


HEADER_GAP_FROM = "2001-06-01 00:00:00"


# --------------------------------------------------------------------------- messages and streams

def encode_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages produced from the table, compared through their parsed fields."""
    m = event_messages(si.app_events(spark, sf))
    parsed = F.from_json("value", EVENT_MESSAGE_DDL.replace("event_id int", "event_id bigint")
                         .replace("user_id int", "user_id bigint"))
    return m.select(parsed.alias("m"), F.size(F.json_object_keys("value")).alias("n_keys"),
                    F.col("value").contains('"payload":null').alias("payload_null_kept")) \
            .select("m.*", "n_keys", "payload_null_kept")


SEED_ROWS = [  # fixed values: the reference's 8 seed events (user, type, payload)
    (1, "click", '{"button": "buy_now"}'),
    (2, "purchase", '{"item_id": 42, "amount": 99.99}'),
    (3, "login", None),
    (4, "signup", '{"referral": "promo2024"}'),
    (5, "logout", None),
    (6, "page_view", '{"page": "/home"}'),
    (7, "add_to_cart", '{"item_id": 17}'),
    (8, "checkout", '{"total": 149.50, "currency": "USD"}'),
]


def _load_checked(df: DataFrame, table_name: str, spec, reject_path: str) -> None:
    """P08 before the write: rows breaking a per-row rule go to ``reject_path`` (a
    ``varchar(64)`` overflow would otherwise fail the whole insert)."""
    good, bad = quality.split_valid(df, spec)
    good.write.insertInto(table_name)
    bad.write.mode("append").parquet(reject_path)


def seed_events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table is loaded, then the 8 seed rows are inserted with generated
    ids (after the current maximum) and the statement's default time; grouped count after."""
    root = scratch_dir(spark, "seed")
    prefix = "q" + root.rsplit("-", 1)[-1] + "_"
    bootstrap(spark, root, prefix=prefix, tables={"app.events": TABLES["app.events"]})
    name = f"{prefix}app.events"
    _load_checked(si.app_events(spark, sf), name, TABLES["app.events"], f"{root}/rejected")
    values = ", ".join(
        f"({i}, {u}, '{t}', {('NULL' if p is None else repr(p))})" for i, (u, t, p) in enumerate(SEED_ROWS, 1))
    spark.sql(f"""INSERT INTO {name} (event_id, user_id, event_type, payload)
                  SELECT (SELECT coalesce(max(event_id), 0) FROM {name}) + ord, u, t, p
                  FROM VALUES {values} AS seed(ord, u, t, p)""")
    return agg.grouped_count(spark.table(name), "event_type")


def stream_decode_events(spark: SparkSession, sf: str) -> DataFrame:
    """A file stream of messages decoded to the 5 typed columns; messages that do not
    decode go to a quarantine folder of the same stream."""
    src = _message_dir(spark, sf, "stream-src")
    out, ck = scratch_dir(spark, "stream-decoded"), scratch_dir(spark, "stream-decoded-ck")
    run_available(decode_event_stream(file_messages(spark, src), out, ck, trigger={"availableNow": True}))
    return spark.read.parquet(f"{out}/events").select(*EVENT_MESSAGE_FIELDS)


def stream_json_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Message stream -> JSON files with checkpoint; a second start on the
    same checkpoint finds nothing new and adds nothing."""
    src = _message_dir(spark, sf, "sink-src")
    out, ck = scratch_dir(spark, "sink-out"), scratch_dir(spark, "sink-ck")
    for _ in range(2):
        for q in events_to_json_files(file_messages(spark, src, max_files_per_trigger=2), out, ck, f"{out}-bad",
                                      trigger={"availableNow": True}):
            run_available(q)
    return read_json(spark, out, EVENT_MESSAGE_DDL).select(*EVENT_MESSAGE_FIELDS)


def table_replace(spark: SparkSession, sf: str) -> DataFrame:
    """JSON files -> lake table, created twice with different data (the second wins)."""
    root = scratch_dir(spark, "lake")
    prefix = "q" + root.rsplit("-", 1)[-1]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}_lake LOCATION '{root}/db'")
    name = f"{prefix}_lake.events"
    src = read_json(spark, _message_dir(spark, sf, "lake-src"), EVENT_MESSAGE_DDL)
    replace_table(src.withColumn("event_type", F.upper("event_type")), name, f"{root}/v1")
    replace_table(src, name, f"{root}/v2")
    return spark.table(name).select(*EVENT_MESSAGE_FIELDS)


def lake_events_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """The reference notebook end to end: table rows -> messages (K04) ->
    stream decode (S01/D06) -> JSON files (K01/K02) -> inferred JSON scan (S02) ->
    create-or-replace lake table (K03) -> grouped count ordered by type (A02/O01)."""
    src = _message_dir(spark, sf, "lake-msgs")
    out, ck = scratch_dir(spark, "lake-raw"), scratch_dir(spark, "lake-raw-ck")
    for q in events_to_json_files(file_messages(spark, src), out, ck, f"{out}-bad", trigger={"availableNow": True}):
        run_available(q)
    root = scratch_dir(spark, "lake-db")
    db = "q" + root.rsplit("-", 1)[-1] + "_lake"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{root}/db'")
    replace_table(read_json(spark, out), f"{db}.events", f"{root}/events")
    return spark.sql(f"SELECT count(*) AS cnt, event_type FROM {db}.events GROUP BY event_type ORDER BY event_type")


# --------------------------------------------------------------------------- decoders

def decode_symbols_q(spark: SparkSession, sf: str) -> DataFrame:
    """Exchange info decoded; empty status dropped."""
    return decode_symbols(si.exchange_info(spark, sf)).good.select(
        "symbol", "status", "base_asset", "quote_asset", "base_precision", "quote_precision")


TRADE_OUT = ["symbol", "agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "trade_time",
             "is_buyer_maker", "is_best_match"]


def decode_agg_trades_q(spark: SparkSession, sf: str) -> DataFrame:
    """Trade pages decoded; trades with an empty price dropped."""
    return decode_agg_trades(si.trade_pages(spark, sf)).good.select(*TRADE_OUT)


TICKER_OUT = ["symbol", "price_change", "price_change_pct", "weighted_avg", "last_price", "last_qty", "open_price",
              "high_price", "low_price", "volume", "quote_volume", "open_time", "close_time", "first_trade_id",
              "last_trade_id", "trade_count"]


def decode_ticker_q(spark: SparkSession, sf: str) -> DataFrame:
    """Ticker bodies decoded; the one with an empty last price rejected."""
    t = agg.ticker_from_trades(si.agg_trades(spark, sf))
    return decode_ticker(si.ticker_responses(t)).good.select(*TICKER_OUT)


def decode_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies that are not JSON are quarantined whole, first 500 bytes kept."""
    bad = decode_agg_trades(si.malformed_pages(spark, sf)).rejects
    return bad.select("symbol", "endpoint", "reason", "raw_bytes")


def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """A page per event, most with a fault: every fault's reason, the item and the
    whole body or element, kept to be decoded again."""
    bad = decode_agg_trades(si.odd_pages(spark, sf)).rejects
    return bad.select("symbol", "reason", "item", "raw_text", "raw_bytes", "fetched_at")


def event_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that do not decode, with their reason and whole text."""
    return decode_events(si.odd_messages(spark, sf)).rejects.select("reason", "item", "raw_text", "raw_bytes")


# --------------------------------------------------------------------------- writes

def upsert_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols table, then an update batch where each key appears twice (last wins);
    committed as a new table version and read back."""
    tbl = VersionedTable(spark, scratch_dir(spark, "symbols"))
    base = decode_symbols(si.exchange_info(spark, sf)).good
    keep = keep_last_symbols(base)
    tbl.commit(keep)
    upd = decode_symbols(si.exchange_info(spark, sf, update=True)).good
    tbl.commit(upsert(tbl.read(), upd, ["symbol"], "ord", refresh={"fetched_at": F.localtimestamp()}))
    return tbl.read().select("symbol", "status", "base_asset", "quote_asset", "base_precision", "quote_precision")


def keep_last_symbols(decoded: DataFrame) -> DataFrame:
    from ..operators.write import keep_last
    return keep_last(decoded, ["symbol"], "ord").drop("ord")


def _trade_batch(trades: DataFrame) -> DataFrame:
    """Insert batch: trades with ``id % 10 >= 3`` in id order, then the same rows again with
    price + 1 (all of which must be ignored)."""
    b = trades.filter(F.col("agg_trade_id") % 10 >= 3)
    first = b.withColumn("_ord", F.struct(F.lit(0).alias("pass"), F.col("agg_trade_id").alias("id")))
    again = b.withColumn("price", (F.col("price") + 1).cast(PRICE)) \
             .withColumn("_ord", F.struct(F.lit(1).alias("pass"), F.col("agg_trade_id").alias("id")))
    return first.unionByName(again)


def _stored_trades(trades: DataFrame) -> DataFrame:
    return trades.filter(F.col("agg_trade_id") % 10 < 5)


def _packed_store(spark: SparkSession, sf: str, name: str) -> TradeStore:
    """A store that got the trades in three commits and was compacted by (symbol, time)."""
    store = TradeStore(spark, scratch_dir(spark, name))
    trades = add_month(si.agg_trades(spark, sf), "trade_time").withColumn("_ord", F.lit(0))
    for k in range(3):
        store.insert(trades.filter(F.col("agg_trade_id") % 3 == k), "_ord", store.log.snapshot(), batch_id=k)
    store.compact()
    return store


def trade_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    """K16/K14 on a market table: three symbols over four days of the compacted trade store;
    the month prunes folders, sorted files prune by symbol and time."""
    trades = _packed_store(spark, sf, "packed").trades()
    return (trades.filter(month_filter("trade_time", "2024-01-10 00:00:00", "2024-01-13 23:59:59"))
            .filter(F.col("symbol").isin("CLICK", "PURCHASE", "VIEW")).select(*TRADE_OUT))


def insert_ignore_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Stored trades + a batch overlapping them with duplicates: every trade ends
    up once, at its first (original) price. The key index tells stored from new keys."""
    store = TradeStore(spark, scratch_dir(spark, "trades"))
    trades = si.agg_trades(spark, sf)
    store.insert(add_month(_stored_trades(trades), "trade_time").withColumn("_ord", F.lit(0)), "_ord", store.log.snapshot())
    store.insert(add_month(_trade_batch(trades), "trade_time"), "_ord", store.log.snapshot(), batch_id=1)
    return store.trades().select(*TRADE_OUT)


def write_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Rows attempted and rows inserted per symbol for the insert batch above."""
    root = scratch_dir(spark, "trades-m")
    trades = si.agg_trades(spark, sf)
    write_layout(add_month(_stored_trades(trades), "trade_time"), root, partition_by=("ym",),
                 sort_by=("symbol", "trade_time"))
    batch = add_month(_trade_batch(trades), "trade_time")
    res = insert_ignore(spark.read.parquet(root), batch, ["symbol", "agg_trade_id"], "_ord", range_col="agg_trade_id")
    return res.metrics


def high_water_mark(spark: SparkSession, sf: str) -> DataFrame:
    """Mark per symbol from decoded trades."""
    return high_water_marks(decode_agg_trades(si.trade_pages(spark, sf)).good).drop("updated_at")


def _stored_state(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of the first half of the month, for every symbol except SIGNUP."""
    t = si.agg_trades(spark, sf).filter(F.col("trade_time") < F.lit("2024-01-16").cast("timestamp_ntz"))
    return high_water_marks(t).filter(F.col("symbol") != "SIGNUP")


def state_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted (worker, symbol) keys -> stored mark or none."""
    wanted = si.agg_trades(spark, sf).select(F.lit("agg_trades").alias("worker_type"), "symbol") \
        .unionByName(decode_symbols(si.exchange_info(spark, sf)).good
                     .select(F.lit("agg_trades").alias("worker_type"), "symbol")).distinct()
    return paging.state_lookup(wanted, _stored_state(spark, sf))


def incremental_page(spark: SparkSession, sf: str) -> DataFrame:
    """Next page of at most 1000 trades per symbol after its mark; newest 1000
    for a symbol without a mark."""
    return paging.incremental_page(si.agg_trades(spark, sf), _stored_state(spark, sf)) \
        .select("symbol", "agg_trade_id", "price", "trade_time", "page_row", "from_state")


def resume_after_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Two ingestion runs; the second also replays the pages of the first run's
    last day. Trades end up once each, and marks are the maxima."""
    store = TradeStore(spark, scratch_dir(spark, "resume"))
    pages = si.trade_pages(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    ingest_trade_pages(store, pages.filter(F.col("fetched_at") < cut), batch_id=0)
    replay_from = F.lit("2024-01-15").cast("timestamp_ntz")
    ingest_trade_pages(store, pages.filter(F.col("fetched_at") >= replay_from), batch_id=1)
    tr = store.trades()
    summary = tr.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"),
                                       F.count_distinct("agg_trade_id").alias("distinct_ids"),
                                       F.sum("price").alias("sum_price"))
    return summary.join(store.marks().select("symbol", "last_id", "last_timestamp"), "symbol", "left")


def stream_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trade pages arrive as files; foreachBatch inserts new trades; a later file
    repeating earlier pages inserts nothing."""
    src, ck = scratch_dir(spark, "pages-src"), scratch_dir(spark, "pages-ck")
    store = TradeStore(spark, scratch_dir(spark, "pages-store"))
    pages = si.trade_pages(spark, sf).drop("page_no")
    pages.write.json(f"{src}/a")
    for sub in ("a", "b"):
        if sub == "b":
            pages.filter(F.col("fetched_at") >= F.lit(REPEAT_FROM).cast("timestamp_ntz")).write.json(f"{src}/b")
        q = start_trade_stream(store, response_stream(spark, f"{src}/*"), ck,
                               trigger={"availableNow": True})
        run_available(q)
    return store.trades().select(*TRADE_OUT)


def _deduplicated_runs(spark: SparkSession, sf: str):
    """A store fed by the deduplicating stream: all pages, then a restart that meets the pages
    of the last days again."""
    src, ck = scratch_dir(spark, "seen-src"), scratch_dir(spark, "seen-ck")
    store = TradeStore(spark, scratch_dir(spark, "seen-store"))
    pages = si.trade_pages(spark, sf).drop("page_no")
    pages.write.json(f"{src}/a")
    runs = []
    for sub in ("a", "b"):
        if sub == "b":
            pages.filter(F.col("fetched_at") >= F.lit(REPEAT_FROM).cast("timestamp_ntz")).write.json(f"{src}/b")
        runs.append(start_deduplicated_trade_stream(store, response_stream(spark, f"{src}/*"), ck, trigger={"availableNow": True}))
        run_available(runs[-1])
    return store, runs


def deduplicated_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The trades that the deduplicating stream stored, across a restart."""
    return _deduplicated_runs(spark, sf)[0].trades().select(*TRADE_OUT)


def stream_state(spark: SparkSession, sf: str) -> DataFrame:
    """What the deduplicating stream handed to the store and quarantined, per symbol, beside the
    rows in its state and the repeats dropped there after the restart (one value each)."""
    store, runs = _deduplicated_runs(spark, sf)
    put = store.metrics().groupBy("symbol").agg(F.sum("attempted").alias("attempted"), F.sum("inserted").alias("inserted"))
    bad = store.rejects().groupBy("symbol").agg(F.count(F.lit(1)).alias("rejected"))
    state = state_report(runs[-1])
    return put.join(bad, "symbol", "full").select(
        "symbol", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("attempted", "inserted", "rejected")],
        *[F.lit(state[c]).cast("bigint").alias(c) for c in ("state_rows", "repeats_dropped")])


def ticker_append(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded tickers appended twice (no dedup)."""
    path = scratch_dir(spark, "ticker")
    t = decode_ticker(numbered_responses(si.ticker_responses(agg.ticker_from_trades(si.agg_trades(spark, sf))))).good
    for i in range(2):
        observed_append(t, path, f"ticker_append_{i}")   # K12: rows written, seen by the write itself
    return spark.read.parquet(path).select(*TICKER_OUT)


def stream_ticker(spark: SparkSession, sf: str) -> DataFrame:
    """T04/K11 in a stream: ticker responses arrive as files; the stored rows are read back."""
    src, ck, root = (scratch_dir(spark, n) for n in ("ticker-src", "ticker-ck", "ticker-store"))
    si.ticker_responses(agg.ticker_from_trades(si.agg_trades(spark, sf))).write.json(src)
    run_available(start_ticker_stream(root, response_stream(spark, src), ck, trigger={"availableNow": True}))
    return spark.read.parquet(f"{root}/ticker_24hr").select(*TICKER_OUT)


# --------------------------------------------------------------------------- model-implied

def ticker_from_trades(spark: SparkSession, sf: str) -> DataFrame:
    """A10: 24-hour statistics per symbol from trades."""
    return agg.ticker_from_trades(si.agg_trades(spark, sf)).select(
        "symbol", "open_price", "last_price", "high_price", "low_price", "volume", "quote_volume",
        "weighted_avg", "price_change", "price_change_pct", "first_trade_id", "last_trade_id", "trade_count",
        "open_time", "close_time", "agg_trade_rows", "quote_volume_exact")


def daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Daily aggregates of event values per type."""
    return agg.daily_rollup(table(spark, sf, "events"), "ts", "value", "event_type", "user_id", "value")


def stored_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """A08 kept in its table: three batches of events, one of which comes twice, added to the
    rollup's state, merged, written with the model's types and read back."""
    root = scratch_dir(spark, "rollup")
    roll = DailyRollup(spark, root, {"value": "value"})
    events = table(spark, sf, "events")
    for batch in (0, 1, 1, 2):
        roll.update(events.filter(F.col("event_id") % 3 == batch), batch)
    roll.compact()
    roll.store(f"{root}/daily_aggregates")
    spec = TABLES["analytics.daily_aggregates"]
    return spark.read.schema(spec.ddl).parquet(f"{root}/daily_aggregates")


def session_facts(spark: SparkSession, sf: str) -> DataFrame:
    """8-hour-gap sessions per user and one fact row per session, in one pass over the events."""
    return agg.gap_session_facts(si.user_events(spark, sf), SESSION_GAP_S)


def stock_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Daily on-hand stock per warehouse and product from movements."""
    return agg.stock_snapshot(si.stock_movements(spark, sf))


def stored_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """W01 kept in its table: movements of four spans of time and a batch of late ones, one batch
    comes twice; the snapshots are carried on, corrected, written with the model's types and read back."""
    root = scratch_dir(spark, "snapshots")
    snaps = StockSnapshots(spark, root)
    moves = si.stock_movements(spark, sf)
    late = F.coalesce(F.col("product_id") % 11 == 3, F.lit(False)) & F.coalesce(F.col("quantity") % 5 == 0, F.lit(False))
    year = F.coalesce(F.year("movement_timestamp"), F.lit(0))
    batch = F.when(late, 4).when(year < 1994, 0).when(year < 1996, 1).when(year < 1998, 2).otherwise(3)
    for n in (0, 1, 2, 2, 3, 4):
        snaps.update(moves.where(batch == n), n)
    snaps.compact()
    snaps.store(f"{root}/warehouse_snapshots")
    return spark.read.schema(TABLES["inventory.warehouse_snapshots"].ddl).parquet(f"{root}/warehouse_snapshots")


# --------------------------------------------------------------------------- functions and text

def factorial_udf(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL factorial applied to ``p_size - 25`` of every part."""
    fn = register_factorial(spark)
    register_factorial(spark)  # create-or-replace twice: idempotent
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") - 25).cast("bigint").alias("n"))
    return p.select("p_partkey", "n", F.call_function(fn, F.col("n")).alias("factorial"))


def string_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """every document split on commas, items trimmed / right-trimmed of '/' /
    lower-cased, then quoted and joined."""
    d = table(spark, sf, "documents")
    items = split_clean(F.col("text"))
    return d.select("doc_id", F.size(items).alias("n_items"), quote_join(items).alias("quoted"))


def replace_first_q(spark: SparkSession, sf: str) -> DataFrame:
    """first-match-only case-insensitive rewrite, and rewrite inside every match."""
    p = table(spark, sf, "pages")
    return p.select(
        "page_id",
        replace_first(F.col("html"), "<P>", "<p data-first=\"1\">").alias("first_rewritten"),
        replace_within(F.col("html"), r'href="[^"]*"', "example", "{domain}").alias("links_rewritten"))


def response_disposition(spark: SparkSession, sf: str) -> DataFrame:
    """Disposition of every recorded response, counted per endpoint and status."""
    return telemetry.response_disposition(si.recorded_responses(spark, sf))


def weight_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Responses whose used-weight header crosses an alert level."""
    r = si.recorded_responses(spark, sf)
    a = r.select("event_id", "endpoint", F.col("used_weight").try_cast("int").alias("used_weight"),
                 telemetry.weight_alert(F.col("used_weight")).alias("alert"))
    return a.filter(F.col("alert").isin("warn", "pause"))


def weight_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Weight used per minute and endpoint against the 5000 budget."""
    return telemetry.weight_budget(si.recorded_responses(spark, sf))


def bootstrap_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Bootstrap all tables twice (no change the second time), load the event
    stand-in into app.events, list tables with their row counts."""
    root = scratch_dir(spark, "warehouse")
    prefix = "q" + root.rsplit("-", 1)[-1] + "_"
    made = bootstrap(spark, root, prefix=prefix)
    again = bootstrap(spark, root, prefix=prefix)
    if made != again:
        raise RuntimeError("bootstrap is not idempotent")
    _load_checked(si.app_events(spark, sf), f"{prefix}app.events", TABLES["app.events"], f"{root}/rejected")
    return agg.table_counts({name[len(prefix):]: spark.table(name) for name in made})
