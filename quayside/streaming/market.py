"""Order-book and ticker streams over recorded responses (T04 for the other two data
types; trades are in ``trades``). One query per data type serves all symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decode import decode_order_book, decode_ticker, numbered_responses
from ..operators.write import read_or_empty, stream_key, write_batch_partition, write_header_detail
from .trades import POLL_SECONDS


def _start(responses: DataFrame, per_batch, checkpoint: str, trigger: dict | None, default_s: int):
    return (responses.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": f"{default_s} seconds"})).start())


def _written(df: DataFrame, path: str, batch_id: int, stream_id: str) -> DataFrame:
    """What a micro-batch stored in a table: its own partition, nothing is decoded again and no
    other batch is listed. A batch without rows has no partition."""
    return read_or_empty(df.sparkSession, f"{path}/stream_id={stream_id}/batch_id={batch_id}", "symbol string")


def book_counts(headers: DataFrame, levels: DataFrame) -> DataFrame:
    """Snapshots and levels written per symbol; a symbol of empty books has 0 levels."""
    n = headers.groupBy("symbol").agg(F.count(F.lit(1)).alias("snapshots"))
    m = levels.groupBy(F.col("symbol").alias("l_symbol")).agg(F.count(F.lit(1)).alias("levels"))
    return n.join(m, F.col("symbol").eqNullSafe(F.col("l_symbol")), "left").select("symbol", "snapshots", F.coalesce("levels", F.lit(0)).cast("bigint").alias("levels"))


def ticker_counts(tickers: DataFrame) -> DataFrame:
    """Ticker rows written per symbol."""
    return tickers.groupBy("symbol").agg(F.count(F.lit(1)).alias("tickers"))


def start_book_stream(root: str, responses: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Book responses -> snapshot headers + levels (+ quarantine), every 5 s by default.
    The books of a micro-batch are numbered, parsed and staged in one pass; headers, levels and
    rejects made from that copy share their ids. Written idempotently per batch id."""
    stream_id = stream_key(checkpoint)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        book = decode_order_book(df, staged="books")
        write_header_detail(book.headers, book.levels, root, batch_id, stream_id)
        write_batch_partition(book.rejects, f"{root}/orderbook_rejects", batch_id, stream_id)
        counts = book_counts(*(_written(df, f"{root}/{t}", batch_id, stream_id) for t in ("orderbook_snapshots", "orderbook_levels")))
        write_batch_partition(counts, f"{root}/orderbook_metrics", batch_id, stream_id)
    return _start(responses, per_batch, checkpoint, trigger, POLL_SECONDS["depth"])


def start_ticker_stream(root: str, responses: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Ticker responses -> plain append of the 21-column rows (K11), every 30 s by default."""
    stream_id = stream_key(checkpoint)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        t = decode_ticker(numbered_responses(df, "ticker-responses"))
        write_batch_partition(t.good, f"{root}/ticker_24hr", batch_id, stream_id)
        write_batch_partition(t.rejects, f"{root}/ticker_rejects", batch_id, stream_id)
        write_batch_partition(ticker_counts(_written(df, f"{root}/ticker_24hr", batch_id, stream_id)), f"{root}/ticker_metrics", batch_id, stream_id)
    return _start(responses, per_batch, checkpoint, trigger, POLL_SECONDS["ticker24hr"])
