"""DuckDB statements that compute, from the raw driver tables, what each query must
return. They restate the stand-in rules (FIXTURES.md) and the expected semantics in
plain SQL; they share no code with the Spark side."""

from __future__ import annotations

ISO = ("CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') "
       "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END")

APP_EVENTS = f"""SELECT event_id, user_id, event_type,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS payload, ts AS created_at, {ISO} AS created_iso
FROM events"""

TRADES = """SELECT upper(event_type) AS symbol, event_id AS agg_trade_id,
       CAST(CAST(value AS DECIMAL(18,2)) + CAST(event_id % 10 AS DECIMAL(2,0)) * 0.000000000001 AS DECIMAL(38,18))
         AS price,
       CAST(1 + user_id % 7 + CASE WHEN event_id % 1009 = 0 THEN 1000000000000 ELSE 0 END AS DECIMAL(38,18))
         AS quantity,
       event_id * 3 AS first_trade_id, event_id * 3 + event_id % 3 AS last_trade_id,
       date_trunc('millisecond', ts) AS trade_time, user_id % 2 = 0 AS is_buyer_maker, true AS is_best_match
FROM events"""

TRADE_COLS = ("symbol, agg_trade_id, price, quantity, first_trade_id, last_trade_id, trade_time, "
              "is_buyer_maker, is_best_match")


def _levels(depth: int | None = None) -> str:
    cut = "" if depth is None else f" WHERE li < {depth}"
    return f"""SELECT * FROM (
  SELECT l_orderkey, side, l_extendedprice, l_quantity,
         row_number() OVER (PARTITION BY l_orderkey, side ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                            l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS li
  FROM (SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN 'bid' ELSE 'ask' END AS side FROM lineitem
        WHERE l_partkey % 50 NOT IN (0, 1))
){cut}"""


def _levels_out(depth: int | None = None) -> str:
    return f"""SELECT 'SYM' || CAST(l_orderkey % 3 AS VARCHAR) AS symbol, l_orderkey * 10 AS last_update_id, side,
       CAST(li AS SMALLINT) AS level_index,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,18)) AS price,
       CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DECIMAL(38,18)) AS quantity
FROM ({_levels(depth)})"""


TICKER = f"""WITH t AS ({TRADES}),
e AS (SELECT symbol, max(trade_time) AS end_t FROM t GROUP BY symbol),
w AS (SELECT t.* FROM t JOIN e USING (symbol) WHERE t.trade_time > e.end_t - INTERVAL 24 HOUR),
a AS (
  SELECT symbol,
         arg_min(price, (trade_time, agg_trade_id)) AS open_price,
         arg_max(price, (trade_time, agg_trade_id)) AS last_price,
         arg_max(quantity, (trade_time, agg_trade_id)) AS last_qty,
         max(price) AS high_price, min(price) AS low_price,
         sum(quantity) AS volume, CAST(sum(CAST(price AS DECIMAL(32,12)) * CAST(quantity AS DECIMAL(19,0))) AS DECIMAL(38,18))
           AS quote_volume,
         min(trade_time) AS open_time, max(trade_time) AS close_time,
         arg_min(agg_trade_id, (trade_time, agg_trade_id)) AS first_trade_id,
         arg_max(agg_trade_id, (trade_time, agg_trade_id)) AS last_trade_id,
         CAST(sum(last_trade_id - first_trade_id + 1) AS BIGINT) AS trade_count,
         count(*) AS agg_trade_rows
  FROM w GROUP BY symbol)
SELECT symbol, last_price - open_price AS price_change,
       round(100.0 * CAST(last_price - open_price AS DOUBLE) / CAST(open_price AS DOUBLE), 3) AS price_change_pct,
       round(CAST(quote_volume AS DOUBLE) / CAST(volume AS DOUBLE), 6) AS weighted_avg,
       last_price, last_qty, open_price, high_price, low_price, volume, quote_volume, open_time, close_time,
       first_trade_id, last_trade_id, trade_count, agg_trade_rows, true AS quote_volume_exact
FROM a"""

# of the text: a decimal of a floating number would show its binary digits
D = "CAST(CAST({} AS VARCHAR) AS DECIMAL(38,18))"
DECODED_TICKER = f"""SELECT symbol, {D.format('price_change')} AS price_change,
       {D.format('price_change_pct')} AS price_change_pct, {D.format('weighted_avg')} AS weighted_avg,
       {D.format('last_price')} AS last_price, {D.format('last_qty')} AS last_qty,
       {D.format('open_price')} AS open_price, {D.format('high_price')} AS high_price,
       {D.format('low_price')} AS low_price, {D.format('volume')} AS volume,
       {D.format('quote_volume')} AS quote_volume, open_time, close_time, first_trade_id, last_trade_id, trade_count
FROM ({TICKER}) WHERE symbol <> 'SIGNUP'"""

STATE = f"""SELECT 'agg_trades' AS worker_type, symbol, max(agg_trade_id) AS last_id,
       arg_max(trade_time, agg_trade_id) AS last_timestamp
FROM ({TRADES}) WHERE trade_time < TIMESTAMP '2024-01-16 00:00:00' AND symbol <> 'SIGNUP' GROUP BY symbol"""

SYMBOLS_BASE = """SELECT upper(n_name) AS symbol, n_nationkey,
       CASE WHEN n_nationkey % 5 = 0 THEN 'BREAK' WHEN n_nationkey % 11 = 10 THEN '' ELSE 'TRADING' END AS status,
       n_name AS base_asset, r_name AS quote_asset, 8 AS base_precision, 5 + n_nationkey % 4 AS quote_precision
FROM nation JOIN region ON n_regionkey = r_regionkey"""

USER_EVENTS = """SELECT event_id, user_id, event_type, date_trunc('millisecond', ts) AS event_timestamp,
       '/' || json_extract_string(props, '$.k') AS page_url, value AS duration_seconds,
       CASE WHEN user_id % 2 = 1 THEN 'mobile' ELSE 'desktop' END AS device_type
FROM events"""

RESPONSES = """SELECT event_id, ts AS fetched_at,
       CASE WHEN event_type = 'signup' THEN 'exchangeInfo' WHEN event_type = 'purchase' THEN 'ticker24hr'
            WHEN event_type = 'error' THEN 'depth' ELSE 'aggTrades' END AS endpoint,
       CASE event_id % 20 WHEN 0 THEN 429 WHEN 1 THEN 418 WHEN 2 THEN 400 WHEN 3 THEN 503 WHEN 4 THEN 404
            ELSE 200 END AS status,
       CASE WHEN event_id % 20 = 0 AND event_id % 40 = 0 THEN '5' ELSE '' END AS retry_after,
       CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN 'abc' ELSE CAST(event_id % 6000 AS VARCHAR) END
         AS used_weight
FROM events"""

MOVEMENTS = """SELECT l_partkey AS product_id, CAST(l_suppkey % 10 AS INTEGER) AS warehouse_id,
       CASE WHEN l_returnflag = 'N' THEN -CAST(trunc(l_quantity) AS INTEGER)
            ELSE CAST(trunc(l_quantity) AS INTEGER) END AS quantity, l_shipdate
FROM lineitem"""

# white space as Go's TrimSpace sees it, spelled with chr() so the SQL holds the characters
GO_SPACES = "(" + " || ".join(f"chr({c})" for c in [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                                      0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) + ")"

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
BOOT_TABLES = ("app.events", "crypto.symbols", "crypto.agg_trades", "crypto.orderbook_snapshots",
               "crypto.orderbook_levels", "crypto.ticker_24hr", "crypto.ingest_state", "analytics.user_events",
               "analytics.daily_aggregates", "analytics.session_facts", "inventory.products",
               "inventory.stock_movements", "inventory.warehouse_snapshots")

MSG_COLS = "CAST(event_id AS INTEGER) AS event_id, CAST(user_id AS INTEGER) AS user_id, event_type, payload, " \
           "created_iso AS created_at"

SQL: dict[str, str] = {}

SQL["events_by_type"] = "SELECT count(*) AS cnt, event_type FROM events GROUP BY event_type ORDER BY event_type"

SQL["table_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in DRIVER_TABLES)

SQL["events_projection"] = f"SELECT event_id, user_id, event_type, payload, created_at FROM ({APP_EVENTS})"

SQL["json_scan_infer"] = f"SELECT event_id, user_id, event_type, payload, created_iso AS created_at FROM ({APP_EVENTS})"

SQL["top_n"] = "SELECT event_id, user_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 100"

SQL["predicate_mix"] = r"""SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part
WHERE p_name NOT LIKE 'red\_%' ESCAPE '\'
  AND p_type IN ('ECONOMY', 'SMALL', 'STANDARD', 'LARGE')
  AND p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')
  AND NOT starts_with(p_name, 'blue')
ORDER BY p_brand, p_size, p_partkey"""

SQL["include_exclude"] = """SELECT event_id, user_id, event_type FROM events
WHERE event_type IN ('click', 'view', 'purchase', 'signup') AND event_type NOT IN ('view', 'signup')"""

SQL["time_range_scan"] = f"""SELECT event_id, user_id, event_type, event_timestamp, page_url FROM ({USER_EVENTS})
WHERE user_id = 7 AND event_timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'"""

SQL["index_predicates"] = """
SELECT 'sku_eq' AS predicate, count(*) AS matches FROM part WHERE 'SKU-' || CAST(p_partkey AS VARCHAR) = 'SKU-42'
UNION ALL SELECT 'category_eq_price_range', count(*) FROM part
  WHERE p_brand = 'Brand#4' AND CAST(p_retailprice AS DECIMAL(18,2)) BETWEEN 950 AND 1500
UNION ALL SELECT 'active_only', count(*) FROM part WHERE p_size % 2 = 1
UNION ALL SELECT 'warehouse_in', count(*) FROM lineitem WHERE l_suppkey % 10 IN (1, 2, 3)
UNION ALL SELECT 'outbound_qty_le', count(*) FROM lineitem
  WHERE l_returnflag = 'N' AND -CAST(trunc(l_quantity) AS INTEGER) <= -40"""

SQL["partitioned_write_read"] = f"""SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS ym,
       count(*) AS movements, CAST(sum(quantity) AS BIGINT) AS net_quantity
FROM ({MOVEMENTS}) GROUP BY 1"""

SQL["sharded_read_count"] = "SELECT count(*) AS row_count, CAST(sum(event_id) AS BIGINT) AS sum_event_id FROM events"

SQL["side_counts"] = f"""SELECT count(*) FILTER (WHERE side = 'bid') AS bid_levels,
       count(*) FILTER (WHERE side = 'ask') AS ask_levels FROM ({_levels()})"""

SQL["distinct_symbols"] = """SELECT 'agg_trades' AS table_name, count(DISTINCT upper(event_type)) AS n_symbols FROM events
UNION ALL SELECT 'orderbook_snapshots', count(DISTINCT l_orderkey % 3) FROM lineitem"""

SQL["orderbook_headers"] = """SELECT DISTINCT 'SYM' || CAST(l_orderkey % 3 AS VARCHAR) AS symbol,
       l_orderkey * 10 AS last_update_id, 20 AS depth_level FROM lineitem"""

SQL["orderbook_levels"] = _levels_out(3)

SQL["book_with_header"] = f"""SELECT symbol, last_update_id, 20 AS depth_level, side, level_index, price, quantity
FROM ({_levels_out()})"""

SQL["market_metrics"] = f"""SELECT 'SYM' || CAST(k AS VARCHAR) AS symbol, CAST(sum(s) AS BIGINT) AS snapshots, CAST(sum(n) AS BIGINT) AS levels,
       CAST(0 AS BIGINT) AS tickers
FROM (SELECT l_orderkey % 3 AS k, count(DISTINCT l_orderkey) AS s, 0 AS n FROM lineitem GROUP BY 1
      UNION ALL SELECT l_orderkey % 3, 0, count(*) FROM ({_levels()}) GROUP BY 1) GROUP BY k
UNION ALL SELECT symbol, 0, 0, count(*) FROM ({DECODED_TICKER}) GROUP BY symbol"""

SQL["quality_report"] = f"""WITH checks AS (
  SELECT 1 AS o, 'symbols' AS check_name,
         (SELECT count(*) FROM ({SYMBOLS_BASE}) WHERE status <> '') AS actual, 3 AS minimum
  UNION ALL SELECT 2, 'agg_trades', (SELECT count(*) FROM events WHERE event_id % 97 <> 0), 1
  UNION ALL SELECT 3, 'orderbook_snapshots', (SELECT count(DISTINCT l_orderkey) FROM lineitem), 1
  UNION ALL SELECT 4, 'orderbook_levels', (SELECT count(*) FROM ({_levels()})), 1
  UNION ALL SELECT 5, 'ticker_24hr', (SELECT count(DISTINCT upper(event_type)) FROM events
                                       WHERE upper(event_type) <> 'SIGNUP'), 1
  UNION ALL SELECT 6, 'ingest_state', (SELECT count(DISTINCT upper(event_type)) FROM events
                                        WHERE event_id % 97 <> 0), 1
  UNION ALL SELECT 7, 'bid_levels', (SELECT count(*) FROM ({_levels()}) WHERE side = 'bid'), 1
  UNION ALL SELECT 8, 'ask_levels', (SELECT count(*) FROM ({_levels()}) WHERE side = 'ask'), 1
  UNION ALL SELECT 9, 'ticker_symbols', (SELECT count(DISTINCT upper(event_type)) FROM events
                                          WHERE upper(event_type) <> 'SIGNUP'), 3
), s AS (SELECT check_name, CAST(actual AS BIGINT) AS actual, CAST(minimum AS BIGINT) AS minimum,
                CASE WHEN actual >= minimum THEN 'PASS' ELSE 'FAIL' END AS status FROM checks)
SELECT * FROM s
UNION ALL SELECT 'ALL', CAST(count(*) FILTER (WHERE status = 'PASS') AS BIGINT), CAST(count(*) AS BIGINT),
       CASE WHEN count(*) FILTER (WHERE status = 'PASS') = count(*) THEN 'PASS' ELSE 'FAIL' END FROM s"""

TICKER_COLS = """symbol price_change price_change_pct weighted_avg prev_close last_price last_qty bid_price bid_qty ask_price ask_qty
open_price high_price low_price volume quote_volume open_time close_time first_trade_id last_trade_id trade_count fetched_at"""


def _planted(table: str, cols: str, key: str, rows: str, id_sql: str) -> str:
    """Violations of a table whose column j is null where id % 101 = j and whose rows with
    id % 101 = 100 come twice."""
    out = [f"UNION ALL SELECT '{table}', 'not_null:{c}', count(*) FROM {rows} x WHERE {id_sql} % 101 = {j}" for j, c in enumerate(cols.split())]
    out += [f"UNION ALL SELECT '{table}', 'not_null:{c}', CAST(0 AS BIGINT)" for c in key.split()]
    return "\n".join([*out, f"UNION ALL SELECT '{table}', 'unique:{key.replace(' ', ',')}', count(*) FROM {rows} x WHERE {id_sql} % 101 = 100"])


def _copied(table: str, cols: str, key: str, rows: str) -> str:
    """Violations of a table whose rows come once per column, which is null there."""
    out = [f"UNION ALL SELECT '{table}', 'not_null:{c}', count(*) FROM {rows}" for c in cols.split()]
    out += [f"UNION ALL SELECT '{table}', 'not_null:{c}', CAST(0 AS BIGINT)" for c in key.split() if key != "id"]
    return "\n".join([*out, f"UNION ALL SELECT '{table}', 'unique:{key.replace(' ', ',')}', count(*) * {len(cols.split()) - 1} FROM {rows}"])


SQL["constraint_report"] = f"""WITH d AS (
  SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_id,
         repeat(event_type, CAST(event_id % 12 + 1 AS INTEGER)) AS event_type, ts AS created_at FROM events)
SELECT 'app.events' AS table_name, 'not_null:event_id' AS rule, CAST(count(*) FILTER (WHERE event_id IS NULL) AS BIGINT) AS violations FROM d
UNION ALL SELECT 'app.events', 'not_null:user_id', count(*) FILTER (WHERE user_id IS NULL) FROM d
UNION ALL SELECT 'app.events', 'not_null:event_type', count(*) FILTER (WHERE event_type IS NULL) FROM d
UNION ALL SELECT 'app.events', 'not_null:created_at', count(*) FILTER (WHERE created_at IS NULL) FROM d
UNION ALL SELECT 'app.events', 'max_length:event_type<=64', count(*) FILTER (WHERE length(event_type) > 64) FROM d
UNION ALL SELECT 'app.events', 'unique:event_id', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM
  (SELECT event_id, count(*) AS n FROM d GROUP BY event_id HAVING count(*) > 1)
{_planted("crypto.agg_trades", "price quantity first_trade_id last_trade_id trade_time is_buyer_maker is_best_match inserted_at",
          "symbol agg_trade_id", "events", "event_id")}
{_planted("crypto.orderbook_snapshots", "symbol last_update_id depth_level snapshot_time", "snapshot_id", "(SELECT DISTINCT l_orderkey FROM lineitem)", "l_orderkey * 10")}
{_planted("crypto.orderbook_levels", "price quantity", "snapshot_id side level_index", f"({_levels()})", "l_orderkey * 10")}
UNION ALL SELECT 'crypto.orderbook_levels', 'allowed:side', count(*) FROM ({_levels()}) WHERE l_orderkey * 10 % 101 = 2
UNION ALL SELECT 'crypto.orderbook_levels', 'orphan', count(*) + count(*) FILTER (WHERE l_orderkey * 10 % 101 = 100) FROM ({_levels()}) lv
  JOIN (SELECT l_orderkey, max(l_shipdate) AS fetched_at FROM lineitem GROUP BY l_orderkey) b USING (l_orderkey)
  WHERE b.fetched_at >= TIMESTAMP '2001-06-01 00:00:00'
{_copied("crypto.symbols", "status base_asset quote_asset base_precision quote_precision fetched_at", "symbol", f"({SYMBOLS_BASE}) WHERE status <> ''")}
{_copied("crypto.ticker_24hr", TICKER_COLS, "id", f"({DECODED_TICKER})")}
{_copied("crypto.ingest_state", "updated_at", "worker_type symbol", f"(SELECT DISTINCT upper(event_type) AS symbol FROM events)")}"""

SQL["encode_messages"] = f"""SELECT event_id, user_id, event_type, payload, created_iso AS created_at, 5 AS n_keys,
       payload IS NULL AS payload_null_kept FROM ({APP_EVENTS})"""

SQL["seed_events"] = """SELECT count(*) AS cnt, event_type FROM (
  SELECT event_type FROM events UNION ALL
  SELECT * FROM (VALUES ('click'), ('purchase'), ('login'), ('signup'), ('logout'), ('page_view'), ('add_to_cart'),
                        ('checkout')) v(event_type))
GROUP BY event_type ORDER BY event_type"""

SQL["stream_decode_events"] = f"SELECT {MSG_COLS} FROM ({APP_EVENTS})"
SQL["stream_json_sink"] = SQL["stream_decode_events"]
SQL["table_replace"] = SQL["stream_decode_events"]
SQL["lake_events_by_type"] = SQL["events_by_type"]

SQL["decode_symbols"] = f"""SELECT symbol, status, base_asset, quote_asset, base_precision, quote_precision
FROM ({SYMBOLS_BASE}) WHERE status <> ''"""

SQL["decode_agg_trades"] = f"SELECT {TRADE_COLS} FROM ({TRADES}) WHERE agg_trade_id % 97 <> 0"

SQL["decode_ticker"] = DECODED_TICKER

SQL["decode_rejects"] = """SELECT 'PAGE' || CAST(page_id AS VARCHAR) AS symbol, 'aggTrades' AS endpoint,
       'unexpected_json_container' AS reason,
       CAST(least(500, octet_length(encode(html))) AS INTEGER) AS raw_bytes FROM pages"""

_ITEM = """'[{"a":' || event_id || ',"p":"%s","q":"1","f":1,"l":2,"T":5,"m":true,"M":false}]'"""
SQL["reject_reasons"] = f"""WITH b AS (SELECT event_id, date_trunc('millisecond', ts) AS fetched_at, event_id % 8 AS k FROM events WHERE event_id % 8 <> 0),
r AS (SELECT *, CASE k WHEN 1 THEN '[{{"a":' || event_id WHEN 2 THEN '[{{"a":"' || event_id || '"}}]' WHEN 3 THEN '{{"a":' || event_id || '}}'
       WHEN 4 THEN ' ' WHEN 5 THEN {_ITEM % "1.x"} WHEN 6 THEN {_ITEM % ""}
       ELSE {_ITEM % "1.5"} END AS body FROM b),
t AS (SELECT *, CASE WHEN k IN (5, 6) THEN body[2:len(body) - 1] ELSE body END AS raw_text FROM r)
SELECT 'E' || event_id AS symbol,
       CASE k WHEN 1 THEN 'malformed_json' WHEN 2 THEN 'json_type_mismatch' WHEN 3 THEN 'unexpected_json_container' WHEN 4 THEN 'empty_body'
         WHEN 5 THEN 'bad_decimal' WHEN 6 THEN 'empty_price_or_quantity' ELSE 'status_not_ok' END AS reason,
       CASE WHEN k IN (5, 6) THEN CAST(event_id AS VARCHAR) END AS item, raw_text,
       CAST(octet_length(encode(raw_text)) AS INTEGER) AS raw_bytes, fetched_at FROM t"""

SQL["event_rejects"] = """SELECT reason, item, raw_text, CAST(octet_length(encode(raw_text)) AS INTEGER) AS raw_bytes FROM (
  SELECT 'malformed_json' AS reason, CAST(NULL AS VARCHAR) AS item, '{"event_id":' || event_id AS raw_text FROM events WHERE event_id % 11 = 3
  UNION ALL SELECT 'bad_number', 'n' || event_id, '{"event_id":"n' || event_id || '","user_id":7}' FROM events WHERE event_id % 11 = 5)"""

SQL["upsert_symbols"] = f"""SELECT symbol, CASE WHEN n_nationkey % 2 = 0 THEN 'TRADING' ELSE status END AS status,
       base_asset, quote_asset, base_precision, quote_precision
FROM ({SYMBOLS_BASE}) WHERE status <> '' OR n_nationkey % 2 = 0"""

SQL["insert_ignore_trades"] = f"SELECT {TRADE_COLS} FROM ({TRADES})"

SQL["trade_range_scan"] = f"""SELECT {TRADE_COLS} FROM ({TRADES})
WHERE symbol IN ('CLICK', 'PURCHASE', 'VIEW')
  AND trade_time BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-13 23:59:59'"""

SQL["write_metrics"] = """SELECT upper(event_type) AS symbol, 2 * count(*) FILTER (WHERE event_id % 10 >= 3) AS attempted,
       count(*) FILTER (WHERE event_id % 10 >= 5) AS inserted FROM events GROUP BY 1"""

SQL["high_water_mark"] = f"""SELECT 'agg_trades' AS worker_type, symbol, max(agg_trade_id) AS last_id,
       arg_max(trade_time, agg_trade_id) AS last_timestamp
FROM ({TRADES}) WHERE agg_trade_id % 97 <> 0 GROUP BY symbol"""

SQL["state_lookup"] = f"""WITH wanted AS (
  SELECT DISTINCT 'agg_trades' AS worker_type, symbol FROM (
    SELECT upper(event_type) AS symbol FROM events
    UNION ALL SELECT symbol FROM ({SYMBOLS_BASE}) WHERE status <> ''))
SELECT w.worker_type, w.symbol, s.last_id, s.last_timestamp, s.last_id IS NOT NULL AS has_state
FROM wanted w LEFT JOIN ({STATE}) s ON w.worker_type = s.worker_type AND w.symbol = s.symbol"""

SQL["incremental_page"] = f"""WITH j AS (
  SELECT t.*, s.last_id FROM ({TRADES}) t LEFT JOIN ({STATE}) s USING (symbol)
  WHERE s.last_id IS NULL OR t.agg_trade_id >= s.last_id + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY
        CASE WHEN last_id IS NULL THEN -agg_trade_id ELSE agg_trade_id END) AS page_row FROM j)
SELECT symbol, agg_trade_id, price, trade_time, CAST(page_row AS INTEGER) AS page_row,
       last_id IS NOT NULL AS from_state FROM r WHERE page_row <= 1000"""

SQL["resume_after_replay"] = f"""SELECT symbol,
       count(*) FILTER (WHERE agg_trade_id % 97 <> 0) AS trades,
       count(DISTINCT agg_trade_id) FILTER (WHERE agg_trade_id % 97 <> 0) AS distinct_ids,
       sum(price) FILTER (WHERE agg_trade_id % 97 <> 0) AS sum_price,
       max(agg_trade_id) AS last_id, arg_max(trade_time, agg_trade_id) AS last_timestamp
FROM ({TRADES}) GROUP BY symbol"""

SQL["stream_trades"] = SQL["decode_agg_trades"]

SQL["deduplicated_trades"] = SQL["decode_agg_trades"]

# one state row per trade; the second run meets every trade of the pages fetched from 2024-01-20 on
SQL["stream_state"] = f"""WITH t AS ({TRADES}),
repeated AS (SELECT count(*) AS n FROM t GROUP BY symbol, agg_trade_id // 1000 HAVING max(trade_time) >= TIMESTAMP '2024-01-20')
SELECT symbol, count(*) FILTER (WHERE agg_trade_id % 97 <> 0) AS attempted,
       count(*) FILTER (WHERE agg_trade_id % 97 <> 0) AS inserted, count(*) FILTER (WHERE agg_trade_id % 97 = 0) AS rejected,
       (SELECT count(*) FROM t) AS state_rows, CAST((SELECT coalesce(sum(n), 0) FROM repeated) AS BIGINT) AS repeats_dropped
FROM t GROUP BY symbol"""

SQL["stream_books"] = _levels_out()

SQL["stream_ticker"] = DECODED_TICKER

SQL["ticker_append"] = f"SELECT * FROM ({DECODED_TICKER}) UNION ALL SELECT * FROM ({DECODED_TICKER})"

SQL["ticker_from_trades"] = f"""SELECT symbol, open_price, last_price, high_price, low_price, volume, quote_volume,
       weighted_avg, price_change, price_change_pct, first_trade_id, last_trade_id, trade_count, open_time,
       close_time, agg_trade_rows, quote_volume_exact FROM ({TICKER})"""

SQL["daily_rollup"] = """SELECT CAST(ts AS DATE) AS dt, 'value' AS metric_name, event_type AS dimension_key,
       count(*) AS total_count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_sum,
       CAST(min(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS min_value,
       CAST(max(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS max_value,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_value,
       count(DISTINCT user_id) AS unique_users
FROM events GROUP BY 1, 2, 3"""

SQL["stored_rollup"] = f"""SELECT *, CAST(year(dt) * 100 + month(dt) AS INTEGER) AS ym FROM ({SQL["daily_rollup"]})"""

SQL["session_facts"] = f"""WITH g AS (
  SELECT *, CASE WHEN lag(event_timestamp) OVER w IS NULL
                   OR event_timestamp - lag(event_timestamp) OVER w > INTERVAL 8 HOUR THEN 1 ELSE 0 END AS new_s
  FROM ({USER_EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY event_timestamp, event_id)),
s AS (SELECT *, CAST(sum(new_s) OVER (PARTITION BY user_id ORDER BY event_timestamp, event_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_no
      FROM g)
SELECT CAST(user_id AS VARCHAR) || '-' || CAST(session_no AS VARCHAR) AS session_id, user_id, session_no,
       min(event_timestamp) AS started_at, max(event_timestamp) AS ended_at, count(*) AS page_count,
       (epoch_ms(max(event_timestamp)) - epoch_ms(min(event_timestamp))) // 1000 AS session_seconds,
       CAST(sum(CAST(duration_seconds AS DECIMAL(18,2))) AS DOUBLE) AS total_duration_seconds,
       count(*) = 1 AS is_bounce,
       arg_min(page_url, (event_timestamp, event_id)) AS entry_url,
       arg_max(page_url, (event_timestamp, event_id)) AS exit_url,
       arg_min(device_type, (event_timestamp, event_id)) AS device_type
FROM s GROUP BY user_id, session_no"""

SQL["stock_snapshot"] = f"""WITH d AS (
  SELECT CAST(l_shipdate AS DATE) AS snapshot_date, warehouse_id, product_id, sum(quantity) AS net,
         bool_or(quantity > 0) AS inbound
  FROM ({MOVEMENTS}) GROUP BY 1, 2, 3)
SELECT snapshot_date, warehouse_id, product_id, CAST(sum(net) OVER w AS BIGINT) AS quantity_on_hand,
       CAST(0 AS BIGINT) AS quantity_reserved, CAST(sum(net) OVER w AS BIGINT) AS quantity_available,
       max(CASE WHEN inbound THEN snapshot_date END) OVER w AS last_restock_date, CAST(0 AS BIGINT) AS reorder_point
FROM d WINDOW w AS (PARTITION BY warehouse_id, product_id ORDER BY snapshot_date
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

SQL["stored_snapshots"] = f"""SELECT snapshot_date, warehouse_id, product_id, CAST(quantity_on_hand AS INTEGER) AS quantity_on_hand,
       CAST(quantity_reserved AS INTEGER) AS quantity_reserved, CAST(quantity_available AS INTEGER) AS quantity_available,
       last_restock_date, reorder_point, CAST(year(snapshot_date) * 100 + month(snapshot_date) AS INTEGER) AS ym
FROM ({SQL["stock_snapshot"]})"""

FEW_USERS, FEW_PRODUCTS = "SELECT user_id FROM events WHERE user_id < 5", "SELECT p_partkey FROM part WHERE p_size = 1"
SQL["sharded_tables"] = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{read}' AS read, count(*) AS n FROM ({rows}){where}"
    for name, rows, one, few in (
        ("user_events", USER_EVENTS, "user_id = 7", f"user_id IN ({FEW_USERS})"),
        ("daily_aggregates", SQL["daily_rollup"], "dimension_key = 'click'", None),
        ("session_facts", SQL["session_facts"], "user_id = 7", f"user_id IN ({FEW_USERS})"),
        ("products", "SELECT p_partkey AS product_id FROM part", "product_id = 42", f"product_id IN ({FEW_PRODUCTS})"),
        ("stock_movements", MOVEMENTS, "product_id = 42", f"product_id IN ({FEW_PRODUCTS})"),
        ("warehouse_snapshots", SQL["stock_snapshot"], "warehouse_id = 3 AND product_id = 42", None))
    for read, where in (("rows", ""), ("rows_of_key", f" WHERE {one}"), ("rows_of_keys", f" WHERE {few}" if few else None))
    if where is not None)

SQL["index_predicates"] += f"""
UNION ALL SELECT 'event_type_in', count(*) FROM events WHERE event_type IN ('click', 'purchase')
UNION ALL SELECT 'country_eq', count(*) FROM events WHERE user_id % 3 = 1
UNION ALL SELECT 'dimension_eq', count(DISTINCT CAST(ts AS DATE)) FROM events WHERE event_type = 'click'
UNION ALL SELECT 'duration_range', count(*) FROM ({SQL["session_facts"]}) WHERE total_duration_seconds BETWEEN 100 AND 500
UNION ALL SELECT 'available_le', count(*) FROM ({SQL["stock_snapshot"]}) WHERE quantity_available <= 0"""

SQL["factorial_udf"] = """SELECT p_partkey, CAST(p_size - 25 AS BIGINT) AS n,
       CASE WHEN p_size - 25 BETWEEN 0 AND 20 THEN CAST(factorial(p_size - 25) AS BIGINT) END AS factorial FROM part"""

SQL["string_cleanup"] = f"""SELECT doc_id, CAST(len(items) AS INTEGER) AS n_items,
       array_to_string(list_transform(items, lambda x: '''' || replace(x, '''', '''''') || ''''), ', ') AS quoted
FROM (SELECT doc_id, list_transform(string_split(text, ','),
        lambda x: lower(rtrim(trim(x, {GO_SPACES}), '/'))) AS items
      FROM documents)"""

SQL["replace_first"] = """SELECT page_id, regexp_replace(html, '<P>', '<p data-first="1">', 'i') AS first_rewritten,
       array_to_string(list_transform(range(1, len(segs) + 1),
         lambda i: segs[i] || coalesce(replace(hits[i], 'example', '{domain}'), '')), '') AS links_rewritten
FROM (SELECT page_id, html, string_split_regex(html, 'href="[^"]*"') AS segs,
             regexp_extract_all(html, 'href="[^"]*"') AS hits FROM pages)"""

DISPOSITION = """CASE WHEN status = 200 THEN 'ok' WHEN status = 418 THEN 'ban'
     WHEN status = 429 AND regexp_matches(retry_after, '^[+-]?[0-9]+$') THEN 'retry_after_header'
     WHEN status = 429 THEN 'retry_backoff' WHEN status = 400 THEN 'skip'
     WHEN status >= 500 THEN 'retry_backoff' ELSE 'error' END"""

SQL["response_disposition"] = f"""SELECT endpoint, status, {DISPOSITION} AS disposition, count(*) AS responses
FROM ({RESPONSES}) GROUP BY 1, 2, 3"""

SQL["weight_alerts"] = f"""SELECT event_id, endpoint, TRY_CAST(used_weight AS INTEGER) AS used_weight, alert FROM (
  SELECT *, CASE WHEN NOT regexp_matches(used_weight, '^[+-]?[0-9]+$') THEN 'none'
                 WHEN CAST(used_weight AS BIGINT) >= 5700 THEN 'pause'
                 WHEN CAST(used_weight AS BIGINT) >= 4800 THEN 'warn' ELSE 'ok' END AS alert
  FROM ({RESPONSES})) WHERE alert IN ('warn', 'pause')"""

SQL["weight_budget"] = f"""SELECT *, CAST(sum(weight_used) OVER (PARTITION BY minute_start) AS BIGINT) AS minute_weight,
       sum(weight_used) OVER (PARTITION BY minute_start) > 5000 AS over_budget
FROM (SELECT date_trunc('minute', fetched_at) AS minute_start, endpoint,
             CAST(sum(CASE WHEN endpoint = 'exchangeInfo' THEN 20 ELSE 2 END) AS BIGINT) AS weight_used,
             count(*) AS requests,
             round(CAST(sum(CASE WHEN endpoint = 'exchangeInfo' THEN 20 ELSE 2 END) AS DOUBLE) * 100.0 / 5000, 3)
               AS budget_pct
      FROM ({RESPONSES}) GROUP BY 1, 2)"""

SQL["bootstrap_twice"] = " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, count(*) AS row_count FROM events" if t == "app.events"
     else f"SELECT '{t}', CAST(0 AS BIGINT)" for t in BOOT_TABLES])
