"""Recorded API responses and event messages -> typed tables plus a quarantine.

Every decoder is a chain of Catalyst expressions over the response rows
(``schemas.RESPONSE_DDL``): no Python runs per row, and every response row is
decoded where it lies (no shuffle). Each decoder returns ``Decoded(good, rejects)``;
both are lazy views of the same input, so a caller that writes both should
persist or checkpoint the input first.

Strictness (the reference's decoder rejects a whole body on any type mismatch):
a body is accepted only if (a) its first non-blank character opens the expected
JSON container, (b) it parses, and (c) every known key has the expected JSON type,
JSON null, or is absent, where it is expected (a nested key of the same name does not
count). Go's case-insensitive key fallback is not reproduced.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import (exact_decimal, millis_to_ts, non_empty, utf8_prefix_bytes, utf8_prefix_text,
                               zero_if_null)
from ..schemas import EVENT_MESSAGE_FIELDS
from ..session import stage

RAW_PREFIX_BYTES = 500  # fixed value: bytes of a rejected body shown for inspection
PARSER_STRING_CHARS = 20_000_000   # the JSON parser's longest string; shorter bodies are parsed whole, whatever they hold


class Decoded(NamedTuple):
    good: DataFrame
    rejects: DataFrame


# --------------------------------------------------------------------------- strict check

def _found_ok(found: Column, types: tuple[str, ...]) -> Column:
    """A type ending in ``<`` is a prefix (any element type); others must match whole."""
    ok = found.isNull() | found.isin("VOID", *[t for t in types if not t.endswith("<")])
    for t in types:
        if t.endswith("<"):
            ok = ok | found.startswith(t)
    return ok


def _type_ok(holder: Column, key: str, types: tuple[str, ...]) -> Column:
    """The type found at ``$.key`` itself, so that a nested key of the same name does not count."""
    return _found_ok(F.schema_of_variant(F.try_variant_get(holder, f"$.{key}", "variant")), types)


def _fields_ok(holder: Column, fields: dict[str, tuple[str, ...]]) -> Column:
    """A JSON null, or an object whose known keys all have an expected type."""
    kind = F.schema_of_variant(holder)
    ok = kind.startswith("OBJECT<")
    for key, types in fields.items():
        ok = ok & _type_ok(holder, key, types)
    return kind.isNull() | (kind == "VOID") | ok


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _surely_ok(shape: Column, fields: dict, list_path: str | None, item_fields: dict | None) -> Column:
    """A quick sufficient test on the merged type of the whole body: no key of these names has a
    wrong type at any depth, and the list holds only objects or nulls."""
    ok = F.lit(True)
    for key, types in {**fields, **(item_fields or {})}.items():
        alts = "|".join(re.escape(t) if t.endswith("<") else re.escape(t) + "(?:, |>)" for t in (*types, "VOID"))
        ok = ok & ~shape.rlike(f"(?:<|, ){re.escape(key)}: (?!{alts})")
    if list_path:
        at = "^" if list_path == "$" else f"(?:<|, ){re.escape(list_path[2:])}: "
        ok = ok & shape.rlike(at + "ARRAY<(?:OBJECT<|VOID>)")
    else:
        ok = ok & shape.startswith("OBJECT<")
    return ok


def _large_body_violation(body: Column, fields: dict, list_path: str | None, item_fields: dict | None) -> Column:
    """The strict check of a body that is too large for one variant, or holds a string that is: the
    containers are read with their own types, list elements and scalar fields as variants, and unknown
    keys of the body are passed over. ``body_over_parser_limit`` is left for a known value that the parser
    cannot read. Of a key that the body itself repeats the last counts."""
    if list_path == "$":
        items = F.from_json(body, "array<variant>")
        return _bind(items, lambda v: F.when(v.isNull(), F.when(_well_formed_list(body), F.lit("body_over_parser_limit")).otherwise(F.lit("malformed_json")))
                     .when(~F.forall(v, lambda e: _fields_ok(e, item_fields)), F.lit("json_type_mismatch")))
    lists = [k for k, types in fields.items() if all(t.startswith("ARRAY<") for t in types)]
    inner = {k: tuple(t[len("ARRAY<"):].removesuffix(">") for t in fields[k]) for k in lists}
    shape = ", ".join(f"`{k}` {'array<variant>' if k in lists else 'variant'}" for k in fields)

    def judge(v: Column) -> Column:
        ok = F.lit(True)
        for k, types in fields.items():
            if k not in lists:
                ok = ok & _found_ok(F.schema_of_variant(v[k]), types)
            elif list_path == f"$.{k}":
                ok = ok & F.coalesce(F.forall(v[k], lambda e: _fields_ok(e, item_fields)), F.lit(True))
            elif "" not in inner[k]:
                ok = ok & F.coalesce(_elements_ok(v[k], inner[k]), F.lit(True))
        return F.when(v["_corrupt_record"].isNotNull(), _why_unread(body, lists)).when(~ok, F.lit("json_type_mismatch"))

    return _bind(F.from_json(body, f"{shape}, `_corrupt_record` string"), judge)


def _elements_ok(items: Column, types: tuple[str, ...]) -> Column:
    return F.forall(items, lambda e: _found_ok(F.schema_of_variant(e), types))


def _well_formed_list(body: Column) -> Column:
    return F.from_json(body, "array<struct<`_` string>>").isNotNull()   # passes over what the objects hold


def _why_unread(body: Column, lists: list[str]) -> Column:
    """Why an object was not read: broken text, something else where a list belongs, or one value too large."""
    keys = F.from_json(body, ", ".join([f"`{k}` string" for k in lists] + ["`_corrupt_record` string"]))

    def judge(t: Column) -> Column:
        wrong = F.lit(False)
        for k in lists:
            wrong = wrong | F.coalesce(~t[k].startswith("["), F.lit(False))
        return F.when(t["_corrupt_record"].isNull() & wrong, F.lit("json_type_mismatch")).otherwise(F.lit("body_over_parser_limit"))

    passed_over = _bind(F.from_json(body, "`_` string, `_corrupt_record` string"), lambda t: t["_corrupt_record"].isNull())
    return F.when(~passed_over, F.lit("malformed_json")).otherwise(_bind(keys, judge))


def body_violation(body: Column, top: str, fields: dict[str, tuple[str, ...]], list_path: str | None = None,
                   item_fields: dict[str, tuple[str, ...]] | None = None) -> Column:
    """NULL when the body passes the strict check, else the reason. ``fields`` are keys of the
    body itself, ``item_fields`` those of every element of the list at ``list_path``.

    The parsed body is bound once through a one-element ``transform`` (a lambda
    variable), so it is parsed a single time however many keys are checked; a plain
    shared column would be inlined into every test by the optimizer. Bodies that the quick
    test on the merged type does not settle are read key by key. A body that may be too large
    for one variant is read in parts if it does not parse whole."""
    first = F.regexp_extract(body, r"(?s)^\s*(.)", 1)

    def exact(v: Column) -> Column:
        ok = _fields_ok(v, fields) if fields else F.lit(True)
        if list_path:
            items = F.coalesce(F.try_variant_get(v, list_path, "array<variant>"), F.array().cast("array<variant>"))
            ok = ok & F.forall(items, lambda e: _fields_ok(e, item_fields))
        return ok

    def judge(v: Column) -> Column:
        ok = _bind(F.schema_of_variant(v), lambda shape: F.when(
            _surely_ok(shape, fields, list_path, item_fields), F.lit(True)).otherwise(exact(v)))
        return (F.when(v.isNull() & (F.octet_length(F.encode(body, "UTF-8")) >= PARSER_STRING_CHARS),
                       _large_body_violation(body, fields, list_path, item_fields))
                .when(v.isNull(), F.lit("malformed_json")).when(~ok, F.lit("json_type_mismatch")))

    why = _bind(F.try_parse_json(body), judge)
    return (F.when(body.isNull() | (F.trim(body) == ""), F.lit("empty_body"))
            .when(first != top, F.lit("unexpected_json_container"))
            .otherwise(why))


def _reject_rows(df: DataFrame, reason: Column, item: Column, raw: Column) -> DataFrame:
    """Quarantine rows: the prefix kept for inspection and the whole text (the body, or the
    element as JSON) to decode again."""
    return df.select(
        F.col("endpoint"), F.col("symbol"), reason.alias("reason"), item.cast("string").alias("item"),
        utf8_prefix_text(raw, RAW_PREFIX_BYTES).alias("raw_prefix"),
        F.octet_length(utf8_prefix_bytes(raw, RAW_PREFIX_BYTES)).cast("int").alias("raw_bytes"),
        raw.alias("raw_text"), F.col("fetched_at"))


def _as_json(element: Column) -> Column:
    """The element with all its known keys, nulls too."""
    return F.to_json(element, {"ignoreNullFields": "false"})


def _judged(responses: DataFrame, endpoint: str, *check) -> DataFrame:
    """The responses of an endpoint with ``_why`` = NULL or the reason their body is rejected."""
    answered = F.coalesce(F.col("status") == 200, F.lit(False))
    return responses.filter(F.col("endpoint") == endpoint).withColumn(
        "_why", F.when(~answered, F.lit("status_not_ok")).otherwise(body_violation(F.col("body"), *check)))


def _split_bodies(responses: DataFrame, endpoint: str, top: str, fields: dict, list_path: str | None = None,
                  item_fields: dict | None = None) -> tuple[DataFrame, DataFrame]:
    r = _judged(responses, endpoint, top, fields, list_path, item_fields)
    bad = _reject_rows(r.filter(F.col("_why").isNotNull()), F.col("_why"), F.lit(None), F.col("body"))
    return r.filter(F.col("_why").isNull()).drop("_why"), bad


# --------------------------------------------------------------------------- D02 trades

TRADE_FIELDS = {"a": ("BIGINT",), "p": ("STRING",), "q": ("STRING",), "f": ("BIGINT",), "l": ("BIGINT",),
                "T": ("BIGINT",), "m": ("BOOLEAN",), "M": ("BOOLEAN",)}
TRADE_JSON = "array<struct<a:bigint,p:string,q:string,f:bigint,l:bigint,T:bigint,m:boolean,M:boolean>>"
TRADE_COLUMNS = ["symbol", "agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "trade_time",
                 "is_buyer_maker", "is_best_match", "fetched_at", "page_pos"]


def trade_items(responses: DataFrame) -> DataFrame:
    """D02 core, one pass over the pages: every trade element of every accepted page, typed, with
    ``_why`` = NULL for a good row or the reason it is quarantined, and one row without
    ``page_pos`` for every rejected page. ``raw`` is the whole text of what is rejected."""
    r = _judged(responses, "aggTrades", "[", {}, "$", TRADE_FIELDS).withColumnRenamed("_why", "_page")
    accepted = F.col("_page").isNull()
    nothing = F.array(F.lit(None).cast(TRADE_JSON[len("array<"):-1]))
    items = r.select("endpoint", "symbol", "fetched_at", "_page", F.when(~accepted, F.col("body")).alias("page_body"),
                     F.posexplode(F.when(accepted, F.from_json("body", TRADE_JSON)).otherwise(nothing)).alias("page_pos", "t"))
    flat = items.select("endpoint", "symbol", "fetched_at", "_page", "page_body", "page_pos", F.col("t").alias("element"), "t.*").toDF(
        "endpoint", "symbol", "fetched_at", "_page", "page_body", "page_pos", "element", "a", "p", "q", "f", "l", "T", "buyer", "best")
    flat = flat.select(
        "endpoint", "symbol", "fetched_at", "_page", "page_body", "p", "q", "element",
        F.when(accepted, F.col("page_pos")).alias("page_pos"),
        F.when(accepted, zero_if_null(F.col("a"), 0)).alias("agg_trade_id"),
        exact_decimal(F.col("p")).alias("price"),
        exact_decimal(F.col("q")).alias("quantity"),
        zero_if_null(F.col("f"), 0).alias("first_trade_id"),
        zero_if_null(F.col("l"), 0).alias("last_trade_id"),
        millis_to_ts(zero_if_null(F.col("T"), 0)).alias("trade_time"),
        zero_if_null(F.col("buyer"), False).alias("is_buyer_maker"),
        zero_if_null(F.col("best"), False).alias("is_best_match"))
    why = (F.when(~accepted, F.col("_page"))
           .when(~(non_empty("p") & non_empty("q")), F.lit("empty_price_or_quantity"))
           .when(F.col("price").isNull() | F.col("quantity").isNull(), F.lit("bad_decimal")))
    raw = F.when(~accepted, F.col("page_body")).when(F.col("_why").isNotNull(), _as_json(F.col("element")))
    return flat.withColumn("_why", why).withColumn("raw", raw).drop("element", "p", "q", "_page", "page_body")


def split_trade_items(items: DataFrame) -> Decoded:
    good = items.filter(F.col("_why").isNull()).select(*TRADE_COLUMNS)
    return Decoded(good, _reject_rows(items.filter(F.col("_why").isNotNull()), F.col("_why"), F.col("agg_trade_id"), F.col("raw")))


def decode_agg_trades(responses: DataFrame) -> Decoded:
    """Trade pages -> one row per trade. The symbol comes from the request row, not
    the body. Keys ``m`` and ``M`` differ only in case, so fields are taken by position."""
    return split_trade_items(trade_items(responses))


# --------------------------------------------------------------------------- D01 symbols

SYMBOL_FIELDS = {"symbol": ("STRING",), "status": ("STRING",),
                 "baseAsset": ("STRING",), "quoteAsset": ("STRING",),
                 "baseAssetPrecision": ("BIGINT",), "quotePrecision": ("BIGINT",)}
SYMBOL_JSON = ("struct<symbols:array<struct<symbol:string,status:string,baseAsset:string,quoteAsset:string,"
               "baseAssetPrecision:bigint,quotePrecision:bigint>>>")


def decode_symbols(responses: DataFrame) -> Decoded:
    """Exchange info -> one row per listed symbol; an empty symbol or status (P07) and a
    precision beyond the column's range go to the quarantine.
    ``ord`` = (fetched_at, position) orders rows for keep-last upserts."""
    ok, bad = _split_bodies(responses, "exchangeInfo", "{", {"symbols": ("ARRAY<",)}, "$.symbols", SYMBOL_FIELDS)
    items = ok.select("endpoint", "symbol", "fetched_at",
                      F.posexplode(F.from_json("body", SYMBOL_JSON)["symbols"]).alias("pos", "s"))
    flat = items.select(
        "endpoint", "fetched_at", "pos", "s",
        F.col("s.symbol").alias("sym"), F.col("s.status").alias("status"),
        zero_if_null(F.col("s.baseAsset"), "").alias("base_asset"),
        zero_if_null(F.col("s.quoteAsset"), "").alias("quote_asset"),
        zero_if_null(F.col("s.baseAssetPrecision"), 0).alias("base_precision"),
        zero_if_null(F.col("s.quotePrecision"), 0).alias("quote_precision"))
    fits = lambda c: F.col(c).between(-(1 << 31), (1 << 31) - 1)
    flat = flat.withColumn("_why", F.when(~(non_empty("sym") & non_empty("status")), F.lit("empty_symbol_or_status"))
                           .when(~(fits("base_precision") & fits("quote_precision")), F.lit("number_out_of_range")))
    good = flat.filter(F.col("_why").isNull()).select(
        F.col("sym").alias("symbol"), "status", "base_asset", "quote_asset", F.col("base_precision").cast("int"),
        F.col("quote_precision").cast("int"), "fetched_at", F.struct("fetched_at", "pos").alias("ord"))
    row_bad = _reject_rows(flat.filter(F.col("_why").isNotNull()).withColumnRenamed("sym", "symbol"),
                           F.col("_why"), F.col("symbol"), _as_json(F.col("s")))
    return Decoded(good, bad.unionByName(row_bad))


# --------------------------------------------------------------------------- D03 book

BOOK_FIELDS = {"lastUpdateId": ("BIGINT",),
               "bids": ("ARRAY<ARRAY<STRING>>", "ARRAY<ARRAY<VOID>>", "ARRAY<VOID>"),
               "asks": ("ARRAY<ARRAY<STRING>>", "ARRAY<ARRAY<VOID>>", "ARRAY<VOID>")}
BOOK_JSON = "struct<lastUpdateId:bigint,bids:array<array<string>>,asks:array<array<string>>>"


class DecodedBook(NamedTuple):
    headers: DataFrame
    levels: DataFrame
    rejects: DataFrame


MAX_LEVEL_INDEX = (1 << 15) - 1   # of a smallint column


def numbered_responses(responses: DataFrame, name: str = "responses") -> DataFrame:
    """The responses staged with ``response_no``, their position. A poll that is recorded twice is
    then two snapshots, and headers and levels agree on their ids whenever they are read."""
    return stage(responses.withColumn("response_no", F.monotonically_increasing_id()), name)


def snapshot_id(symbol: Column, last_update_id: Column, fetched_at: Column, depth: Column, response_no: Column) -> Column:
    """K10 surrogate key: a hash of the natural key and the response's position, computed
    where the row is (no global counter, no single-partition window, same value on a task
    retry). That no two headers share one is a rule of the constraint report."""
    return F.xxhash64(symbol, last_update_id, fetched_at, depth, response_no)


def _usable(e: Column) -> Column:
    """An entry has two parts that are not empty (extra parts are ignored)."""
    return ((F.coalesce(F.size(e), F.lit(-1)) >= 2) & non_empty(F.try_element_at(e, F.lit(1)))
            & non_empty(F.try_element_at(e, F.lit(2))))


def cut_levels(levels: DataFrame, depth: int) -> DataFrame:
    """The best ``depth`` levels of each side, cut when read; the stored book keeps all."""
    return levels.filter(F.col("level_index") < depth)


def _parsed_books(responses: DataFrame) -> DataFrame:
    """One row per book response: ``_why`` = NULL and the parsed book, or the reason and the rejected body."""
    no = F.col("response_no") if "response_no" in responses.columns else F.lit(0).cast("bigint")
    r = _judged(responses, "depth", "{", BOOK_FIELDS).withColumn("response_no", no)
    accepted = F.col("_why").isNull()
    book = r.select("endpoint", "symbol", "depth", "fetched_at", "response_no", "_why", F.when(~accepted, F.col("body")).alias("body"),
                    F.when(accepted, F.from_json("body", BOOK_JSON)).alias("b"))
    return book.select(
        "endpoint", "symbol", "depth", "fetched_at", "response_no", "_why", "body",
        zero_if_null(F.col("b.lastUpdateId"), 0).alias("last_update_id"),
        F.col("b.bids").alias("bids"), F.col("b.asks").alias("asks"))


def _split_books(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted books, and the rejected bodies."""
    bad = _reject_rows(parsed.filter(F.col("_why").isNotNull()), F.col("_why"), F.lit(None), F.col("body"))
    return parsed.filter(F.col("_why").isNull()).drop("_why", "body"), bad


def _books(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split_books(_parsed_books(responses))


def book_sizes(responses: DataFrame) -> DataFrame:
    """One row per accepted book with the number of levels that ``decode_order_book`` gives for each
    side (``bid``, ``ask``), counted inside the body: totals need neither the exploded levels nor a second parse."""
    def levels(side: str) -> Column:
        first = F.slice(F.filter(side, _usable), 1, MAX_LEVEL_INDEX + 1)
        exact = F.filter(first, lambda e: exact_decimal(e[0]).isNotNull() & exact_decimal(e[1]).isNotNull())
        return F.coalesce(F.size(exact), F.lit(0)).cast("bigint")
    return _books(responses)[0].select("symbol", "last_update_id", levels("bids").alias("bid"), levels("asks").alias("ask"))


def decode_order_book(responses: DataFrame, staged: str | None = None) -> DecodedBook:
    """K10 header/detail from one decoded input: one header per response (kept even with
    0 levels) and all its usable levels, both carrying the hashed ``snapshot_id``. Level
    indexes are assigned after the drop of unusable entries, which go to the quarantine
    with their position in the body. Responses of :func:`numbered_responses` give every
    response an id of its own; without numbers a poll recorded twice shares one. With ``staged``
    (a name) responses are numbered here and their parsed books staged: a caller that writes all three
    parts has every body judged and parsed once."""
    if staged:
        book, bad = _split_books(stage(_parsed_books(responses.withColumn("response_no", F.monotonically_increasing_id())), staged))
    else:
        book, bad = _books(responses)
    book = book.withColumn("snapshot_id", snapshot_id(
        F.col("symbol"), F.col("last_update_id"), F.col("fetched_at"), F.col("depth"), F.col("response_no")))
    headers = book.select("snapshot_id", "symbol", "last_update_id", F.col("depth").alias("depth_level"),
                          F.col("fetched_at").alias("snapshot_time"))
    sides = F.array(F.struct(F.lit("bid").alias("side"), F.col("bids").alias("entries")),
                    F.struct(F.lit("ask").alias("side"), F.col("asks").alias("entries")))
    per_side = book.select("endpoint", "snapshot_id", "symbol", "last_update_id", "fetched_at",
                           F.inline(sides))
    lv = per_side.select("endpoint", "snapshot_id", "symbol", "last_update_id", "fetched_at", "side",
                         F.posexplode(F.filter("entries", _usable)).alias("level_index", "e"))
    unusable = per_side.select("endpoint", "symbol", "last_update_id", "fetched_at", "side",
                               F.posexplode("entries").alias("pos", "e")).filter(~_usable(F.col("e")))
    entry_bad = _reject_rows(unusable, F.lit("unusable_level"), F.concat_ws(":", "last_update_id", "side", "pos"),
                             F.coalesce(F.to_json("e"), F.lit("null")))
    # generated, not projected: a filter on them is not pushed below, where it would work them out again
    numbers = F.struct(exact_decimal(F.col("e")[0]).alias("price"), exact_decimal(F.col("e")[1]).alias("quantity"))
    lv = lv.select("endpoint", "snapshot_id", "symbol", "last_update_id", "fetched_at", "side", "level_index", "e", F.inline(F.array(numbers)))
    why = (F.when(F.col("price").isNull() | F.col("quantity").isNull(), F.lit("bad_decimal"))
           .when(F.col("level_index") > MAX_LEVEL_INDEX, F.lit("number_out_of_range")))
    lv = lv.withColumn("_why", why)
    levels = lv.filter(F.col("_why").isNull()).select("snapshot_id", "symbol", "last_update_id", "side",
                                                      F.col("level_index").try_cast("smallint").alias("level_index"), "price", "quantity")
    row_bad = _reject_rows(lv.filter(F.col("_why").isNotNull()), F.col("_why"),
                           F.concat_ws(":", "last_update_id", "side", "level_index"), _as_json(F.col("e")))
    return DecodedBook(headers, levels, bad.unionByName(row_bad).unionByName(entry_bad))


# --------------------------------------------------------------------------- D04 ticker

TICKER_TEXT = ("priceChange", "priceChangePercent", "weightedAvgPrice", "prevClosePrice", "lastPrice", "lastQty",
               "bidPrice", "bidQty", "askPrice", "askQty", "openPrice", "highPrice", "lowPrice", "volume",
               "quoteVolume")
TICKER_COLUMNS = ("price_change", "price_change_pct", "weighted_avg", "prev_close", "last_price", "last_qty",
                  "bid_price", "bid_qty", "ask_price", "ask_qty", "open_price", "high_price", "low_price", "volume",
                  "quote_volume")
TICKER_LONG = ("openTime", "closeTime", "firstId", "lastId", "count")
TICKER_JSON = ("struct<symbol:string," + ",".join(f"{k}:string" for k in TICKER_TEXT) + ","
               + ",".join(f"{k}:bigint" for k in TICKER_LONG) + ">")
TICKER_FIELDS = {"symbol": ("STRING",), **{k: ("STRING",) for k in TICKER_TEXT},
                 **{k: ("BIGINT",) for k in TICKER_LONG}}


def decode_ticker(responses: DataFrame) -> Decoded:
    """Ticker -> one row of 21 columns and the time of the fetch, for responses of
    :func:`numbered_responses` with an ``id`` of its own, as the table has it (K11). The
    reference rejects the row when last price or volume is empty; here every one of the 15
    numbers must also parse exactly (Q8)."""
    ok, bad = _split_bodies(responses, "ticker24hr", "{", TICKER_FIELDS)
    numbered = "response_no" in responses.columns
    no = F.col("response_no") if numbered else F.lit(0).cast("bigint")
    t = ok.select("endpoint", "symbol", "fetched_at", no.alias("response_no"), F.from_json("body", TICKER_JSON).alias("t"))
    cols = [F.col(f"t.{k}").alias(f"{c}_text") for k, c in zip(TICKER_TEXT, TICKER_COLUMNS)]
    t = t.select("endpoint", "symbol", "fetched_at", "response_no", F.col("t").alias("element"), *cols,
                 *[zero_if_null(F.col(f"t.{k}"), 0).alias(k) for k in TICKER_LONG])
    t = t.select("*", *[exact_decimal(F.col(f"{c}_text")).alias(c) for c in TICKER_COLUMNS])
    all_parsed = F.lit(True)
    for c in TICKER_COLUMNS:
        all_parsed = all_parsed & F.col(c).isNotNull()
    why = (F.when(~(non_empty("last_price_text") & non_empty("volume_text")), F.lit("empty_last_price_or_volume"))
           .when(~all_parsed, F.lit("bad_decimal")))
    t = t.withColumn("_why", why)
    good = t.filter(F.col("_why").isNull()).select(
        *([F.xxhash64("symbol", "fetched_at", "closeTime", "response_no").alias("id")] if numbered else []), "symbol", *TICKER_COLUMNS,
        millis_to_ts(F.col("openTime")).alias("open_time"), millis_to_ts(F.col("closeTime")).alias("close_time"),
        F.col("firstId").alias("first_trade_id"), F.col("lastId").alias("last_trade_id"),
        F.col("count").alias("trade_count"), "fetched_at")
    row_bad = _reject_rows(t.filter(F.col("_why").isNotNull()), F.col("_why"), F.col("symbol"), _as_json(F.col("element")))
    return Decoded(good, bad.unionByName(row_bad))


# --------------------------------------------------------------------------- D06 events

# the last field is set for a text that is no whole JSON value, of which Spark fills what it read
EVENT_TEXT_JSON = "struct<" + ",".join(f"{f}:string" for f in EVENT_MESSAGE_FIELDS) + ",_broken:string>"


def decode_events(df: DataFrame, value_col: str = "value") -> Decoded:
    """Event messages (any DataFrame with a JSON text column, batch or stream) ->
    the 5 typed columns. Fields are read as text and cast with ``try_cast``: a value
    that does not cast sends the message to the quarantine instead of becoming NULL."""
    v = F.col(value_col).cast("string")
    m = df.select(v.alias("_value"), F.from_json(v, EVENT_TEXT_JSON, {"columnNameOfCorruptRecord": "_broken"}).alias("m"))
    m = m.select("_value", *[F.col(f"m.{f}").alias(f"{f}_text") for f in EVENT_MESSAGE_FIELDS],
                 (F.col("m").isNull() | F.col("m._broken").isNotNull()).alias("_unparsed"))
    typed = m.select(
        "*",
        F.col("event_id_text").try_cast("int").alias("event_id"),
        F.col("user_id_text").try_cast("int").alias("user_id"),
        F.col("event_type_text").alias("event_type"),
        F.col("payload_text").alias("payload"),
        F.col("created_at_text").alias("created_at"))
    cast_failed = ((F.col("event_id_text").isNotNull() & F.col("event_id").isNull())
                   | (F.col("user_id_text").isNotNull() & F.col("user_id").isNull()))
    first = F.regexp_extract(F.col("_value"), r"(?s)^\s*(.)", 1)
    why = (F.when(F.col("_unparsed") | (first != "{"), F.lit("malformed_json"))
           .when(cast_failed, F.lit("bad_number")))
    typed = typed.withColumn("_why", why)
    good = typed.filter(F.col("_why").isNull()).select(*EVENT_MESSAGE_FIELDS)
    rejects = typed.filter(F.col("_why").isNotNull()).select(
        F.lit("events-raw").alias("endpoint"), F.lit(None).cast("string").alias("symbol"),
        F.col("_why").alias("reason"), F.col("event_id_text").alias("item"),
        utf8_prefix_text(F.col("_value"), RAW_PREFIX_BYTES).alias("raw_prefix"),
        F.octet_length(utf8_prefix_bytes(F.col("_value"), RAW_PREFIX_BYTES)).cast("int").alias("raw_bytes"),
        F.col("_value").alias("raw_text"), F.lit(None).cast("timestamp_ntz").alias("fetched_at"))
    return Decoded(good, rejects)
