"""Trade ingestion job: decode a batch of recorded trade pages, insert new trades and
advance the high-water marks in one commit (K07-K09, K12, T05-T06).

Trades, the index of their keys, marks, write counts and rejects are written to folders of
their own and become visible together, when the commit log takes the next version (K09). A
job that dies before leaves nothing visible; of two jobs on one store one wins, and the
other one starts again from what the winner stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import year_month
from ..schemas import REJECT_DDL, TABLES
from ..session import stage
from .commit_log import CommitConflict, CommitLog, Snapshot
from .decode import TRADE_COLUMNS, split_trade_items, trade_items
from .key_index import INDEX_DDL, index_rows, merge_index, split_keys
from .write import advance_marks, high_water_marks, keep_first, write_layout, write_metrics

TRADE_KEY = ["symbol", "agg_trade_id"]
STATE_SCHEMA = TABLES["crypto.ingest_state"].ddl
METRICS_DDL = "symbol string, attempted bigint, inserted bigint, stream_id string, batch_id int"
REJECTS_DDL = REJECT_DDL + ", stream_id string, batch_id int"
TRADES, KEYS, MARKS, METRICS, REJECTS = "agg_trades", "trade_keys", "ingest_state", "write_metrics", "agg_trades_rejects"


@dataclass
class InsertPlan:
    """Rows of a batch that a store lacks, and the slots that had to be probed for them."""
    new: DataFrame
    probed: list[str]


@dataclass
class TradeStore:
    """Trades (``ym``-partitioned Parquet, insert-if-absent) with their marks, write counts and
    rejects. More than ``max_folders`` live folders are packed by :meth:`compact`."""
    spark: SparkSession
    root: str
    max_folders: int = 64

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.root)

    state = log   # the versions of the store

    @property
    def rejects_path(self) -> str:
        return f"{self.root}/{REJECTS}"

    @property
    def metrics_path(self) -> str:
        return f"{self.root}/{METRICS}"

    def trades(self, at: Snapshot | None = None) -> DataFrame:
        """The stored trades, read with the table schema; no rows before the first batch."""
        return self.log.read(TRADES, TABLES["crypto.agg_trades"].ddl, at)

    def metrics(self, at: Snapshot | None = None) -> DataFrame:
        return self.log.read(METRICS, METRICS_DDL, at)

    def rejects(self, at: Snapshot | None = None) -> DataFrame:
        return self.log.read(REJECTS, REJECTS_DDL, at)

    def marks(self, at: Snapshot | None = None) -> DataFrame:
        return self.log.read(MARKS, STATE_SCHEMA, at)

    def missing(self, batch: DataFrame, ord_col: str, at: Snapshot) -> InsertPlan:
        """K07 against the key index: an existing row wins, then the first of the batch. Only
        keys inside blocks with gaps are looked up, and only in the folders of those blocks."""
        first = keep_first(batch, TRADE_KEY, ord_col)
        split = stage(split_keys(first, self.log.read(KEYS, INDEX_DDL, at)), "trade-keys")
        probe = split.filter("state = 'probe'")
        slots = sorted(r[0] for r in probe.select(F.explode("slots")).distinct().collect())   # live slots at most
        new = split.filter("state = 'new'")
        if slots:
            b = probe.agg(F.min("agg_trade_id"), F.max("agg_trade_id")).first()
            held = self.log.read(TRADES, TABLES["crypto.agg_trades"].ddl, at, slots)
            held = held.filter(F.col("agg_trade_id").between(b[0], b[1])).select(*TRADE_KEY)
            new = new.unionByName(probe.join(held, on=TRADE_KEY, how="left_anti"))
        return InsertPlan(new.drop("state", "slots"), slots)

    def insert(self, batch: DataFrame, ord_col: str, at: Snapshot, marks: DataFrame | None = None, rejects: DataFrame | None = None,
               stream_id: str = "batch", batch_id: int = 0) -> dict:
        """Insert the trades the store lacks, replace the marks, and keep counts and rejects of
        (``stream_id``, ``batch_id``) unless they are there from an earlier run: one commit.
        Returns the rows attempted and inserted. A conflict raises and changes nothing."""
        new = self.missing(batch, ord_col, at).new.drop(ord_col).withColumn("inserted_at", F.localtimestamp())
        schema = self.spark.createDataFrame([], TABLES["crypto.agg_trades"].ddl).schema
        staged = stage(new.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), "trade-inserts")
        counts = stage(write_metrics(batch, staged, "symbol").withColumns({"stream_id": F.lit(stream_id), "batch_id": F.lit(batch_id)}), "trade-counts")
        tot = counts.agg(F.sum("attempted"), F.sum("inserted")).first()
        mine = (F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id)
        add: dict[str, dict[str, str]] = {}

        def put(table: str, df: DataFrame, **layout) -> dict[str, str]:
            slot, folder = self.log.new_folder(table)
            write_layout(df, folder, **layout)
            return {slot: folder}

        if tot[1]:
            slot, folder = self.log.new_folder(TRADES)
            write_layout(staged, folder, partition_by=("ym",), sort_by=("symbol", "trade_time"))
            add[TRADES] = {slot: folder}
            add[KEYS] = dict.fromkeys([slot], *put(KEYS, index_rows(staged, slot), sort_by=("symbol", "block")).values())
        if self.metrics(at).filter(mine).isEmpty():   # a replay keeps the first run's counts
            add[METRICS] = put(METRICS, counts)
        if rejects is not None and self.rejects(at).filter(mine).isEmpty():
            bad = stage(rejects.withColumns({"stream_id": F.lit(stream_id), "batch_id": F.lit(batch_id)}), "trade-rejects")
            if not bad.isEmpty():
                add[REJECTS] = put(REJECTS, bad)
        replace = {MARKS: put(MARKS, marks.coalesce(1))} if marks is not None else None
        now = self.log.commit(at, add=add, replace=replace)
        if len(now.slots(TRADES)) > self.max_folders or len(now.slots(METRICS)) > self.max_folders:
            self.compact(now)
        return {"attempted": int(tot[0] or 0), "inserted": int(tot[1] or 0)}

    def compact(self, at: Snapshot | None = None, folder_bytes: int = 512 << 20) -> bool:
        """Pack small folders into one, its trades laid out by (symbol, time) inside the months,
        its key index summed. Folders of ``folder_bytes`` or more are left alone. Counts and
        rejects are packed alike. Published as one commit; False if another writer came first."""
        at = at or self.log.snapshot()
        files, add, remove = self.log.files, {}, {}
        small = {t: [s for s, f in at.slots(t).items() if files.size(f) < folder_bytes] for t in (TRADES, METRICS, REJECTS)}
        if len(small[TRADES]) > 1:
            slot, folder = self.log.new_folder(TRADES)
            write_layout(self.log.read(TRADES, TABLES["crypto.agg_trades"].ddl, at, small[TRADES]), folder,
                         partition_by=("ym",), sort_by=("symbol", "trade_time"))
            _, keys = self.log.new_folder(KEYS)
            write_layout(merge_index(self.log.read(KEYS, INDEX_DDL, at, small[TRADES]), slot), keys, sort_by=("symbol", "block"))
            add |= {TRADES: {slot: folder}, KEYS: {slot: keys}}
            remove |= {TRADES: small[TRADES], KEYS: small[TRADES]}
        for t, ddl in ((METRICS, METRICS_DDL), (REJECTS, REJECTS_DDL)):
            if len(small[t]) > 1:
                slot, folder = self.log.new_folder(t)
                write_layout(self.log.read(t, ddl, at, small[t]), folder, sort_by=("stream_id", "batch_id"))
                add[t], remove[t] = {slot: folder}, small[t]
        if not add:
            return False
        try:
            self.log.commit(at, add=add, remove=remove)
        except CommitConflict:
            return False
        return True


class RejectedBatch(ValueError):
    """Raised in strict mode when a batch holds a row that does not decode."""


def ingest_trade_pages(store: TradeStore, responses: DataFrame, batch_id: int = 0, monotone: bool = False,
                       strict_batch: bool = False, stream_id: str = "batch", retries: int = 3) -> dict:
    """Process one batch of trade-page responses. Returns the rows attempted and inserted.
    Of trades with one key the first fetched is inserted; the rest is as in :func:`ingest_trade_items`."""
    return ingest_trade_items(store, trade_items(responses), ("fetched_at", "page_pos"), batch_id, monotone, strict_batch, stream_id, retries)


def ingest_trade_items(store: TradeStore, items: DataFrame, order: tuple[str, ...], batch_id: int = 0, monotone: bool = False,
                       strict_batch: bool = False, stream_id: str = "batch", retries: int = 3) -> dict:
    """Insert decoded items (``decode.trade_items``); of those with one key the first by ``order``.

    The typed items (good and quarantined, rejected pages too) are staged as a
    Parquet table under the shared checkpoint folder and every later step reads that
    copy. Marks advance over quarantined trades too, so a page whose rows are all invalid
    is not fetched again for ever (SURVEY Q4). With ``strict_batch`` one bad trade aborts the
    whole batch before anything is written, as the reference's single transaction does.

    Quarantined rows and write counts are stored per (``stream_id``, ``batch_id``): a replay
    keeps those of the first run. If another writer commits meanwhile, the insert is worked
    out again on the newer version, up to ``retries`` times."""
    items = stage(items.withColumn("ym", year_month(F.col("trade_time")))
                  .withColumn("_ord", F.struct(*order)), "trade-items")
    elements = items.filter(F.col("page_pos").isNotNull())   # without the rejected pages
    if strict_batch and not elements.filter(F.col("_why").isNotNull()).isEmpty():
        raise RejectedBatch(f"batch {batch_id}: a trade failed to decode; nothing written")
    rejects = split_trade_items(items).rejects
    batch = items.filter(F.col("_why").isNull()).select(*TRADE_COLUMNS, "ym", "_ord")
    marks = high_water_marks(elements.select("symbol", "agg_trade_id", "trade_time"))
    for attempt in range(retries + 1):
        at = store.log.snapshot()
        try:
            return store.insert(batch, "_ord", at, advance_marks(store.marks(at), marks, monotone=monotone), rejects, stream_id, batch_id)
        except CommitConflict:
            if attempt == retries:
                raise
    raise ValueError("retries is negative")
