"""Market-data stream: recorded trade-page responses arriving as files -> trades table
and marks, one micro-batch at a time (T04-T06).

``foreachBatch`` runs the same job as the batch loader (``ingest_trade_pages``). Each
micro-batch is idempotent (insert-if-absent against everything stored), so the
at-least-once replay of a batch after a failure inserts nothing twice, and
duplicates across polls are ignored for all time, not only within a watermark.

``start_deduplicated_trade_stream`` remembers the trades it has seen in the query's keyed state
instead, so overlapping polls never reach the store; the store's own check remains as recovery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decode import trade_items
from ..operators.ingest import TradeStore, ingest_trade_items, ingest_trade_pages
from ..operators.write import stream_key
from ..sources.responses import stream_responses

POLL_SECONDS = {"aggTrades": 5, "depth": 5, "ticker24hr": 30}  # fixed values: reference cadence


def response_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Recorded responses arriving as JSON-lines files (see ``sources.responses``)."""
    return stream_responses(spark, path, "json", max_files_per_trigger)


def drop_repeated_pages(responses: DataFrame) -> DataFrame:
    """T05 inside one micro-batch: the same page (endpoint, symbol, status and body) is decoded
    once, at its first fetch. Pages of earlier batches are not remembered: insert-if-absent
    ignores their trades, however late a page comes."""
    page = F.sha2(F.concat_ws("\u0001", "endpoint", "symbol", F.col("status").cast("string"), "body"), 256)
    cols = responses.columns
    first = F.struct(F.col("fetched_at").isNull(), "fetched_at")  # never null: a page without a fetch time stays, too
    return (responses.groupBy(page.alias("_page")).agg(F.min_by(F.struct(*cols), first).alias("_row"))
            .select("_row.*"))


def start_trade_stream(store: TradeStore, responses: DataFrame, checkpoint: str, trigger: dict | None = None,
                       monotone: bool = False, strict_batch: bool = False):
    """One query for all symbols; default trigger is the reference's 5-second poll."""
    stream_id = stream_key(checkpoint)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        ingest_trade_pages(store, drop_repeated_pages(df), batch_id=batch_id, monotone=monotone,
                           strict_batch=strict_batch, stream_id=stream_id)

    return (responses.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": f"{POLL_SECONDS['aggTrades']} seconds"})).start())


# what tells two versions of a trade apart; of a rejected row its reason and whole text
TRADE_VALUES = ["price", "quantity", "first_trade_id", "last_trade_id", "trade_time", "is_buyer_maker", "is_best_match"]


def unseen_trades(responses: DataFrame) -> DataFrame:
    """T05 by keyed state: the items of a stream (``decode.trade_items``) that no earlier micro-batch
    held. The state has no watermark, so a trade is known for all time; a key and a hash
    of the values are kept per trade. Repeats whose values differ pass, and the store settles them. Rejected
    elements and pages pass once per text. Rows without a symbol or id are keyed like any other."""
    version = F.when(F.col("_why").isNull(), F.xxhash64(*TRADE_VALUES)).otherwise(F.xxhash64("_why", "raw"))
    return trade_items(responses).withColumn("version", version).dropDuplicates(["symbol", "agg_trade_id", "version"])


def start_deduplicated_trade_stream(store: TradeStore, responses: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Trades that the stream has seen are dropped in its state store before anything is
    staged or probed. What passes is inserted if absent, so a lost checkpoint, another writer or a replayed
    batch adds nothing twice. An earlier batch wins over a later one; of versions new in
    one batch the one with the smallest hash, whatever copy of it the state kept. Marks never move back, since
    a batch holds new trades only."""
    stream_id = stream_key(checkpoint)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        ingest_trade_items(store, df, ("version",), batch_id=batch_id,
                           monotone=True, stream_id=stream_id)

    return (unseen_trades(responses).writeStream.foreachBatch(per_batch).outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": f"{POLL_SECONDS['aggTrades']} seconds"})).start())


def state_report(query) -> dict[str, int]:
    """Size of a query's keyed state after its last micro-batch, and the repeats dropped in the micro-batches
    that the query object remembers (``spark.sql.streaming.numRecentProgressUpdates``)."""
    steps = [op for p in query.recentProgress for op in p["stateOperators"]]
    last = query.lastProgress["stateOperators"] if query.lastProgress else []
    return {"state_rows": sum(op["numRowsTotal"] for op in last), "state_bytes": sum(op["memoryUsedBytes"] for op in last),
            "repeats_dropped": sum(op["customMetrics"].get("numDroppedDuplicateRows", 0) for op in steps)}
