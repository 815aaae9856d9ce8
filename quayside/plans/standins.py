"""Stand-in inputs built from the driver tables (rules in FIXTURES.md section 3).

These functions only shape driver rows into the schemas the jobs expect (tables,
recorded responses, messages); none of them does a job's work. Every rule is a
per-row expression or a grouping of rows into response bodies, so a stand-in grows
with the table it is built from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import cut_to_millis, ts_to_millis
from ..schemas import PRICE, TableSpec
from ..sources.tables import table


def _null(t: str):
    return F.lit(None).cast(t)


def _resp(endpoint, symbol, depth, status, retry_after, used_weight, body, fetched_at) -> list:
    return [endpoint.alias("endpoint"), symbol.alias("symbol"), depth.cast("int").alias("depth"),
            status.cast("int").alias("status"), retry_after.alias("retry_after"),
            used_weight.alias("used_weight"), body.alias("body"), fetched_at.alias("fetched_at")]


# --------------------------------------------------------------------------- events family

def app_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", "event_type",
                    F.when(F.col("event_id") % 4 == 0, _null('string')).otherwise(F.col("props")).alias("payload"),
                    F.col("ts").alias("created_at"))


def dirty_app_events(spark: SparkSession, sf: str) -> DataFrame:
    """Constraint-report input: some user ids NULL, some event types over 64 characters."""
    e = app_events(spark, sf)
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias("user_id"),
        F.repeat("event_type", (F.col("event_id") % 12 + 1).cast("int")).alias("event_type"),
        "payload", "created_at")


def agg_trades(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.upper("event_type").alias("symbol"), F.col("event_id").alias("agg_trade_id"),
        (F.col("value").cast("decimal(18,2)") + (F.col("event_id") % 10).cast("decimal(2,0)")
         * F.lit("0.000000000001").cast("decimal(12,12)")).cast(PRICE).alias("price"),
        (F.lit(1) + F.col("user_id") % 7 + F.when(F.col("event_id") % 1009 == 0, 10 ** 12).otherwise(0))
        .cast(PRICE).alias("quantity"),
        (F.col("event_id") * 3).alias("first_trade_id"),
        (F.col("event_id") * 3 + F.col("event_id") % 3).alias("last_trade_id"),
        cut_to_millis(F.col("ts")).alias("trade_time"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"), F.lit(True).alias("is_best_match"))


def trade_pages(spark: SparkSession, sf: str, trades: DataFrame | None = None) -> DataFrame:
    """Recorded trade pages: per symbol, trades grouped by id block of 1000 (at most 1000
    per page), body = JSON array with keys a p q f l T m M, numbers p and q as text;
    p = '' when ``agg_trade_id % 97 = 0``. fetched_at = last trade time on the page."""
    t = trades if trades is not None else agg_trades(spark, sf)
    item = F.struct(
        F.col("agg_trade_id").alias("a"),
        F.when(F.col("agg_trade_id") % 97 == 0, F.lit("")).otherwise(F.col("price").cast("string")).alias("p"),
        F.col("quantity").cast("string").alias("q"),
        F.col("first_trade_id").alias("f"), F.col("last_trade_id").alias("l"),
        ts_to_millis(F.col("trade_time")).alias("T"),
        F.col("is_buyer_maker").alias("m"), F.col("is_best_match").alias("M"))
    pages = t.groupBy("symbol", F.floor(F.col("agg_trade_id") / 1000).alias("page_no")).agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.max("trade_time").alias("fetched_at"))
    return pages.select(*_resp(F.lit("aggTrades"), F.col("symbol"), _null('int'), F.lit(200), _null('string'), _null('string'),
                               F.to_json("items"), F.col("fetched_at")), "page_no")


def exchange_info(spark: SparkSession, sf: str, update: bool = False) -> DataFrame:
    """Exchange-info responses, one per region. Base: every nation; status 'BREAK' when
    ``n_nationkey % 5 = 0``, '' when ``% 11 = 10`` (dropped by the decoder), else
    'TRADING'. Update batch (``update=True``): even keys, each listed twice in one body,
    first 'HALT' then 'TRADING' (the last must win)."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    status = (F.when(F.col("n_nationkey") % 5 == 0, "BREAK").when(F.col("n_nationkey") % 11 == 10, "")
              .otherwise("TRADING"))

    def entry(st):
        return F.struct(F.upper("n_name").alias("symbol"), st.alias("status"), F.col("n_name").alias("baseAsset"),
                        F.col("r_name").alias("quoteAsset"), F.lit(8).alias("baseAssetPrecision"),
                        (F.lit(5) + F.col("n_nationkey") % 4).alias("quotePrecision"))
    if update:
        nr = nr.filter(F.col("n_nationkey") % 2 == 0)
        items = [F.struct(F.lit(0).alias("o"), F.col("n_nationkey").alias("k"), entry(F.lit("HALT")).alias("s")),
                 F.struct(F.lit(1).alias("o"), F.col("n_nationkey").alias("k"), entry(F.lit("TRADING")).alias("s"))]
        nr = nr.select("r_regionkey", F.explode(F.array(*items)).alias("it"))
        fetched = F.lit("2024-02-02 00:00:00").cast("timestamp_ntz")
    else:
        nr = nr.select("r_regionkey", F.struct(F.lit(0).alias("o"), F.col("n_nationkey").alias("k"),
                                               entry(status).alias("s")).alias("it"))
        fetched = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    bodies = nr.groupBy("r_regionkey").agg(F.sort_array(F.collect_list("it")).alias("items"))
    body = F.to_json(F.struct(F.transform("items", lambda x: x["s"]).alias("symbols")))
    return bodies.select(*_resp(F.lit("exchangeInfo"), _null('string'), _null('int'), F.lit(200), _null('string'), _null('string'), body,
                                fetched + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("r_regionkey"))))


def order_books(spark: SparkSession, sf: str, depth: int = 20) -> DataFrame:
    """Book responses, one per order: odd line numbers are bids, even are asks, entries in
    order of all lineitem columns (line number first); price = extended price, quantity =
    quantity, as text; price '' when ``l_partkey % 50 = 0``, a one-element entry when
    ``% 50 = 1`` (both must be dropped by the decoder)."""
    li = table(spark, sf, "lineitem")
    p_txt = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    q_txt = F.col("l_quantity").cast("decimal(18,2)").cast("string")
    entry = (F.when(F.col("l_partkey") % 50 == 1, F.array(p_txt))
             .otherwise(F.array(F.when(F.col("l_partkey") % 50 == 0, F.lit("")).otherwise(p_txt), q_txt)))
    it = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                  "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", entry.alias("e"))
    odd = F.col("l_linenumber") % 2 == 1
    g = li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.when(odd, it))).alias("b"),
        F.sort_array(F.collect_list(F.when(~odd, it))).alias("a"),
        F.max("l_shipdate").alias("fetched_at"))
    body = F.to_json(F.struct((F.col("l_orderkey") * 10).alias("lastUpdateId"),
                              F.transform("b", lambda x: x["e"]).alias("bids"),
                              F.transform("a", lambda x: x["e"]).alias("asks")))
    sym = F.concat(F.lit("SYM"), (F.col("l_orderkey") % 3).cast("string"))
    return g.select(*_resp(F.lit("depth"), sym, F.lit(depth), F.lit(200), _null('string'), _null('string'), body, F.col("fetched_at")))


def ticker_responses(ticker: DataFrame) -> DataFrame:
    """Ticker bodies from computed 24-hour statistics; all 15 numbers as text (bid, ask and
    previous close '0'); the SIGNUP symbol gets an empty last price (must be rejected)."""
    def txt(c):
        return F.col(c).cast("string")
    zero = F.lit("0")
    last = F.when(F.col("symbol") == "SIGNUP", F.lit("")).otherwise(txt("last_price"))
    body = F.to_json(F.struct(
        F.col("symbol").alias("symbol"), txt("price_change").alias("priceChange"),
        txt("price_change_pct").alias("priceChangePercent"), txt("weighted_avg").alias("weightedAvgPrice"),
        zero.alias("prevClosePrice"), last.alias("lastPrice"), txt("last_qty").alias("lastQty"),
        zero.alias("bidPrice"), zero.alias("bidQty"), zero.alias("askPrice"), zero.alias("askQty"),
        txt("open_price").alias("openPrice"), txt("high_price").alias("highPrice"), txt("low_price").alias("lowPrice"),
        txt("volume").alias("volume"), txt("quote_volume").alias("quoteVolume"),
        ts_to_millis(F.col("open_time")).alias("openTime"), ts_to_millis(F.col("close_time")).alias("closeTime"),
        F.col("first_trade_id").alias("firstId"), F.col("last_trade_id").alias("lastId"),
        F.col("trade_count").alias("count")))
    return ticker.select(*_resp(F.lit("ticker24hr"), F.col("symbol"), _null('int'), F.lit(200), _null('string'), _null('string'), body,
                                F.col("close_time")))


def recorded_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One response per event: endpoint by event type, status by ``event_id % 20``,
    Retry-After '5' on half of the 429s, used-weight header '' / 'abc' / a number."""
    e = table(spark, sf, "events")
    endpoint = (F.when(F.col("event_type") == "signup", "exchangeInfo")
                .when(F.col("event_type") == "purchase", "ticker24hr")
                .when(F.col("event_type") == "error", "depth").otherwise("aggTrades"))
    m = F.col("event_id") % 20
    status = (F.when(m == 0, 429).when(m == 1, 418).when(m == 2, 400).when(m == 3, 503).when(m == 4, 404)
              .otherwise(200))
    retry = F.when((m == 0) & (F.col("event_id") % 40 == 0), F.lit("5")).otherwise(F.lit(""))
    w7 = F.col("event_id") % 7
    used = (F.when(w7 == 0, F.lit("")).when(w7 == 1, F.lit("abc"))
            .otherwise((F.col("event_id") % 6000).cast("string")))
    return e.select(*_resp(endpoint, F.upper("event_type"), _null('int'), status, retry, used, _null('string'), F.col("ts")),
                    "event_id")


def malformed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """HTML pages presented as trade-page bodies (every one must be rejected)."""
    p = table(spark, sf, "pages")
    return p.select(*_resp(F.lit("aggTrades"), F.concat(F.lit("PAGE"), F.col("page_id").cast("string")), _null('int'),
                           F.lit(200), _null('string'), _null('string'), F.col("html"),
                           F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "page_id")


def odd_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One trade page per event, seven of eight with a fault: a body cut short, an id as text,
    an object in place of the list, no body, a price that is no number, no price, an error
    status."""
    e = table(spark, sf, "events")
    i = F.col("event_id").cast("string")
    def item(price):
        return F.concat(F.lit('[{"a":'), i, F.lit(',"p":'), F.lit(price), F.lit(',"q":"1","f":1,"l":2,"T":5,"m":true,"M":false}]'))
    k = F.col("event_id") % 8
    body = (F.when(k == 1, F.concat(F.lit('[{"a":'), i)).when(k == 2, F.concat(F.lit('[{"a":"'), i, F.lit('"}]')))
            .when(k == 3, F.concat(F.lit('{"a":'), i, F.lit("}"))).when(k == 4, F.lit(" "))
            .when(k == 5, item('"1.x"')).when(k == 6, item('""')).otherwise(item('"1.5"')))
    return e.select(*_resp(F.lit("aggTrades"), F.concat(F.lit("E"), i), _null("int"), F.when(k == 7, 503).otherwise(200), _null("string"),
                           _null("string"), body, cut_to_millis(F.col("ts"))))


def odd_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Event messages, some cut short and some with an id that is no whole number."""
    e = table(spark, sf, "events")
    i = F.col("event_id").cast("string")
    whole = F.concat(F.lit('{"event_id":'), i, F.lit(',"user_id":7,"event_type":"x","payload":null,"created_at":null}'))
    return e.select(F.when(F.col("event_id") % 11 == 3, F.concat(F.lit('{"event_id":'), i))
                    .when(F.col("event_id") % 11 == 5, F.concat(F.lit('{"event_id":"n'), i, F.lit('","user_id":7}'))).otherwise(whole).alias("value"))


def planted(df: DataFrame, spec: TableSpec, id_col: str | None = None) -> DataFrame:
    """Constraint-report input: every NOT NULL column outside the key broken somewhere, and keys
    repeated. With ``id_col`` column number j is null where id % 101 = j and rows with id % 101
    = 100 come twice; without (tables of a few rows) each row comes once per column, which is
    null there."""
    cols = [c for c in spec.not_null if c not in spec.key]
    if id_col is None:
        one = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))))
        return one.withColumns({c: F.when(F.col("_j") != j, F.col(c)) for j, c in enumerate(cols)}).drop("_j")
    part = df.withColumn("_j", F.col(id_col) % 101)
    broken = part.withColumns({c: F.when(F.col("_j") != j, F.col(c)) for j, c in enumerate(cols)})
    return broken.unionByName(part.filter("_j = 100")).drop("_j")


# --------------------------------------------------------------------------- warehouse family

def user_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "user_id", "event_type", cut_to_millis(F.col("ts")).alias("event_timestamp"),
        F.concat(F.lit("/"), F.get_json_object("props", "$.k")).alias("page_url"),
        F.col("value").alias("duration_seconds"),
        (F.col("user_id") % 2).cast("smallint").alias("is_mobile"),
        F.when(F.col("user_id") % 2 == 1, "mobile").otherwise("desktop").alias("device_type"),
        F.element_at(F.array(F.lit("US"), F.lit("DE"), F.lit("FR")), (F.col("user_id") % 3 + 1).cast("int"))
         .alias("country_code"),
        F.col("props").alias("payload"))


def products(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"), F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_name").alias("product_name"), F.col("p_brand").alias("category"),
        F.col("p_type").alias("subcategory"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
        F.col("p_size").cast("float").alias("weight_kg"), (F.col("p_size") % 2).cast("smallint").alias("is_active"))


def stock_movements(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    mtype = (F.when(F.col("l_returnflag") == "A", "inbound").when(F.col("l_returnflag") == "R", "return")
             .otherwise("outbound"))
    qty = F.col("l_quantity").cast("int")
    return li.select(
        F.col("l_partkey").alias("product_id"), (F.col("l_suppkey") % 10).cast("int").alias("warehouse_id"),
        mtype.alias("movement_type"),
        F.when(F.col("l_returnflag") == "N", -qty).otherwise(qty).alias("quantity"),
        F.col("l_shipdate").alias("movement_timestamp"))
