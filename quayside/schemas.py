"""Table definitions: one dict drives bootstrap DDL, validation and write layout.

Instants are stored as UTC wall time in ``timestamp_ntz`` columns. Prices and
quantities are exact decimals of the widest type, ``decimal(38,18)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

PRICE = "decimal(38,18)"


TICKER_NUMBERS = ("price_change", "price_change_pct", "weighted_avg", "prev_close", "last_price", "last_qty", "bid_price",
                  "bid_qty", "ask_price", "ask_qty", "open_price", "high_price", "low_price", "volume", "quote_volume")


@dataclass(frozen=True)
class TableSpec:
    database: str
    name: str
    ddl: str                      # column list as Spark DDL
    key: tuple[str, ...] = ()     # unique key, checked by validate()
    not_null: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()   # physical partition columns (derived, e.g. ym)
    sort_by: tuple[str, ...] = ()        # sort inside each file, for row-group pruning
    bloom: dict = field(default_factory=dict)   # column -> expected distinct values
    max_length: dict = field(default_factory=dict)  # column -> max characters
    allowed: dict = field(default_factory=dict)     # column -> allowed values

    @property
    def qualified(self) -> str:
        return f"{self.database}.{self.name}"

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self.ddl)


TABLES: dict[str, TableSpec] = {s.qualified: s for s in [
    # operational event table and its message form
    TableSpec("app", "events",
              "event_id bigint, user_id bigint, event_type string, payload string, created_at timestamp_ntz",
              key=("event_id",), not_null=("event_id", "user_id", "event_type", "created_at"),
              max_length={"event_type": 64}),
    # market data
    TableSpec("crypto", "symbols",
              "symbol string, status string, base_asset string, quote_asset string, "
              "base_precision int, quote_precision int, fetched_at timestamp_ntz",
              key=("symbol",), not_null=("symbol", "status", "base_asset", "quote_asset", "base_precision", "quote_precision", "fetched_at")),
    TableSpec("crypto", "agg_trades",
              f"symbol string, agg_trade_id bigint, price {PRICE}, quantity {PRICE}, first_trade_id bigint, "
              "last_trade_id bigint, trade_time timestamp_ntz, is_buyer_maker boolean, is_best_match boolean, "
              "inserted_at timestamp_ntz, ym int",
              key=("symbol", "agg_trade_id"), not_null=("symbol", "agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "trade_time",
                                                          "is_buyer_maker", "is_best_match", "inserted_at"),
              partition_by=("ym",), sort_by=("symbol", "trade_time")),
    TableSpec("crypto", "orderbook_snapshots",
              "snapshot_id bigint, symbol string, last_update_id bigint, depth_level int, snapshot_time timestamp_ntz",
              key=("snapshot_id",), not_null=("snapshot_id", "symbol", "last_update_id", "depth_level", "snapshot_time"),
              sort_by=("symbol", "snapshot_time")),
    TableSpec("crypto", "orderbook_levels",
              f"snapshot_id bigint, side string, level_index smallint, price {PRICE}, quantity {PRICE}",
              key=("snapshot_id", "side", "level_index"),
              not_null=("snapshot_id", "side", "level_index", "price", "quantity"),
              allowed={"side": ("bid", "ask")}),
    TableSpec("crypto", "ticker_24hr",
              "id bigint, symbol string, " + ", ".join(f"{c} {PRICE}" for c in TICKER_NUMBERS) +
              ", open_time timestamp_ntz, close_time timestamp_ntz, first_trade_id bigint, last_trade_id bigint, "
              "trade_count bigint, fetched_at timestamp_ntz",
              key=("id",), not_null=("symbol", *TICKER_NUMBERS, "open_time", "close_time", "first_trade_id", "last_trade_id",
                                     "trade_count", "fetched_at"), sort_by=("symbol", "fetched_at")),
    TableSpec("crypto", "ingest_state",
              "worker_type string, symbol string, last_id bigint, last_timestamp timestamp_ntz, updated_at timestamp_ntz",
              key=("worker_type", "symbol"), not_null=("worker_type", "symbol", "updated_at")),
    # warehouse model
    TableSpec("analytics", "user_events",
              "event_id bigint, user_id bigint, event_type string, event_timestamp timestamp_ntz, page_url string, "
              "session_id string, duration_seconds float, is_mobile smallint, country_code char(2), payload string, ym int",
              partition_by=("ym",), sort_by=("user_id", "event_timestamp"),
              bloom={"country_code": 300}),
    TableSpec("analytics", "daily_aggregates",
              "dt date, metric_name string, dimension_key string, total_count bigint, total_sum double, "
              "min_value double, max_value double, avg_value double, unique_users bigint, ym int",
              partition_by=("ym",), sort_by=("dt", "metric_name"), bloom={"dimension_key": 10000}),
    TableSpec("analytics", "session_facts",
              "session_id string, user_id bigint, started_at timestamp_ntz, ended_at timestamp_ntz, page_count int, "
              "total_duration_seconds bigint, is_bounce smallint, entry_url string, exit_url string, "
              "device_type string, ym int",
              partition_by=("ym",), sort_by=("user_id", "started_at")),
    TableSpec("inventory", "products",
              "product_id bigint, sku string, product_name string, category string, subcategory string, "
              "price decimal(18,2), weight_kg float, created_at timestamp_ntz, updated_at timestamp_ntz, is_active smallint",
              key=("product_id",), partition_by=("is_active",), sort_by=("category", "product_id"),
              bloom={"sku": 1_000_000}),
    TableSpec("inventory", "stock_movements",
              "movement_id bigint, product_id bigint, warehouse_id int, movement_type string, quantity int, "
              "movement_timestamp timestamp_ntz, batch_reference string, operator_id bigint, ym int",
              partition_by=("ym",), sort_by=("product_id", "movement_timestamp")),
    TableSpec("inventory", "warehouse_snapshots",
              "snapshot_date date, warehouse_id int, product_id bigint, quantity_on_hand int, quantity_reserved int, "
              "quantity_available int, last_restock_date date, reorder_point bigint, ym int",
              partition_by=("ym",), sort_by=("snapshot_date", "warehouse_id", "product_id")),
]}

# Message on the event topic and in the raw JSON files: every field is decoded as
# text first, then cast, so that a bad value is caught instead of silently nulled.
EVENT_MESSAGE_DDL = "event_id int, user_id int, event_type string, payload string, created_at string"
EVENT_MESSAGE_FIELDS = ("event_id", "user_id", "event_type", "payload", "created_at")

# Recorded API response rows (input of every decoder).
RESPONSE_DDL = ("endpoint string, symbol string, depth int, status int, retry_after string, "
                "used_weight string, body string, fetched_at timestamp_ntz")

# Quarantine rows written by every decoder.
REJECT_DDL = ("endpoint string, symbol string, reason string, item string, raw_prefix string, raw_bytes int, "
              "raw_text string, fetched_at timestamp_ntz")
