"""Which keys a store holds, without reading it.

Ids of a symbol are cut into blocks of 4,096 numbers. Per commit the store keeps one row per
(symbol, block): the smallest and largest id it inserted there and how many. These rows
add up: counts are sums and bounds are extremes, since a key is inserted once. A block whose
count fills its bounds holds every id between them, so a batch splits without a look at the
stored rows into keys that are surely stored, keys that are surely new, and the few in blocks
with gaps; for those only the folders that touched the block are probed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDS_PER_BLOCK = 4096
INDEX_DDL = "symbol string, block bigint, lo bigint, hi bigint, n bigint, slot string"


def _block(id_col: str):
    return F.floor(F.col(id_col) / F.lit(IDS_PER_BLOCK)).cast("bigint")


def index_rows(rows: DataFrame, slot: str, symbol: str = "symbol", id_col: str = "agg_trade_id") -> DataFrame:
    """Index of rows that enter a store under ``slot`` (each key once)."""
    return (rows.groupBy(F.col(symbol).alias("symbol"), _block(id_col).alias("block"))
            .agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.count(F.lit(1)).alias("n"))
            .withColumn("slot", F.lit(slot)))


def merge_index(index: DataFrame, slot: str) -> DataFrame:
    """Index of the slots of ``index`` once their rows are merged into ``slot``."""
    return (index.groupBy("symbol", "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
            .withColumn("slot", F.lit(slot)))


def split_keys(batch: DataFrame, index: DataFrame, symbol: str = "symbol", id_col: str = "agg_trade_id") -> DataFrame:
    """The batch (unique keys) with ``state``: ``new``, ``stored`` or ``probe``, and for the last
    ``slots``, the slots that may hold the key. An equi-join on (symbol, block): a symbol
    with most of the rows is spread over its blocks. A null key is new."""
    whole = index.groupBy("symbol", "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"),
                                                 F.collect_set("slot").alias("slots"))  # at most the live slots
    w = whole.select(F.col("symbol").alias("_symbol"), F.col("block").alias("_b"), "lo", "hi", "n", "slots")
    j = batch.withColumn("_block", _block(id_col)).join(w, (F.col(symbol) == F.col("_symbol")) & (F.col("_block") == F.col("_b")), "left")
    inside = F.col("lo").isNotNull() & F.col(id_col).between(F.col("lo"), F.col("hi"))
    state = (F.when(~F.coalesce(inside, F.lit(False)), "new").when(F.col("n") == F.col("hi") - F.col("lo") + 1, "stored").otherwise("probe"))
    return j.select(*batch.columns, state.alias("state"), F.when(state == "probe", F.col("slots")).alias("slots"))
