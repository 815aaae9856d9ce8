"""Stock snapshots kept in their table (W01), carried forward batch by batch.

A batch of movements is reduced to one row per (day, warehouse, product). What came before it
is known from a *balance*: rows of (key, net, last day, last restock) that add up by sum and
maximum, so every batch appends its own and none is rewritten. A batch whose days all lie after
the last day of their keys reads the balance only and appends snapshot rows: one more day costs
one day. Late movements correct what follows them: the stored months from the earliest late
day on are read, summed again with the batch, and replaced; earlier months stay untouched.
Balance, rows and the batch's number are one commit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import year_month
from ..schemas import TABLES
from ..session import stage
from .commit_log import CommitConflict, CommitLog, Snapshot
from .write import stream_key, write_layout

KEY = ["warehouse_id", "product_id"]
ROWS_DDL = ("snapshot_date date, warehouse_id int, product_id bigint, net bigint, inbound boolean, on_hand bigint, "
            "restocked date, restocked_before date, ym int")
BALANCE_DDL = "warehouse_id int, product_id bigint, net bigint, last_day date, restocked date"
ROWS, BALANCE, DONE = "snapshot_rows", "balance", "done"
NO_MONTH = 0   # the month of movements without a time; they come before all days


def daily_net(movements: DataFrame) -> DataFrame:
    """One row per (day, warehouse, product): net quantity and whether anything came in. A null
    quantity adds nothing; a null time, warehouse or product is a value of its own."""
    return movements.groupBy(F.to_date("movement_timestamp").alias("snapshot_date"), F.col("warehouse_id").cast("int").alias("warehouse_id"),
                             F.col("product_id").cast("bigint").alias("product_id")).agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("net"), F.coalesce(F.max(F.col("quantity") > 0), F.lit(False)).alias("inbound"))


def merge_balance(balance: DataFrame) -> DataFrame:
    return balance.groupBy(*KEY).agg(F.sum("net").cast("bigint").alias("net"), F.max("last_day").alias("last_day"),
                                     F.max("restocked").alias("restocked"))


def balance_of(daily: DataFrame) -> DataFrame:
    return daily.groupBy(*KEY).agg(F.sum("net").cast("bigint").alias("net"), F.max("snapshot_date").alias("last_day"),
                                   F.max(F.when(F.col("inbound"), F.col("snapshot_date"))).alias("restocked"))


def running_rows(daily: DataFrame, stored: DataFrame, balance: DataFrame) -> DataFrame:
    """The snapshot rows of ``daily`` and ``stored`` together. ``stored`` holds all rows of its
    months and every later one, so a key's stock before them is its balance less their net;
    what was restocked before them stands in the first of them, or else in the balance.

    Days, stored rows and balances (any number per key, with no merge before) meet in one shuffle
    by key: the start of a key is a total over its rows, not a join."""
    none = lambda t: F.lit(None).cast(t)
    days = daily.select(*KEY, F.lit(0).alias("kind"), "snapshot_date", "net", "inbound", none("date").alias("before"))
    held = stored.select(*KEY, F.lit(1).alias("kind"), "snapshot_date", "net", "inbound", F.col("restocked_before").alias("before"))
    start = balance.select(*KEY, F.lit(2).alias("kind"), none("date").alias("snapshot_date"), "net", none("boolean").alias("inbound"), F.col("restocked").alias("before"))
    rows = days.unionByName(held).unionByName(start).repartition(*[F.col(k) for k in KEY])
    is_held, is_start = F.col("kind") == 1, F.col("kind") == 2
    # one row per key and day, and one of the key's balances
    per_day = rows.groupBy(*KEY, is_start.alias("balance"), "snapshot_date").agg(
        F.sum("net").cast("bigint").alias("net"), F.bool_or("inbound").alias("inbound"),
        F.sum(F.when(is_held, F.col("net"))).alias("held"), F.max(F.when(is_start, F.col("before"))).alias("start"),
        F.max(is_held).alias("is_held"), F.max(F.when(is_held, F.col("before"))).alias("before"))
    key = Window.partitionBy(*KEY)
    w = key.orderBy(F.col("balance").desc(), "snapshot_date")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    day = ~F.col("balance")
    first_held = F.struct("snapshot_date", "before")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    restock = F.when(day & F.col("inbound"), F.col("snapshot_date"))
    run = per_day.withColumns({
        "run": F.sum("net").over(upto), "taken": F.sum("held").over(whole), "r": F.max(restock).over(upto), "rb": F.max(restock).over(before),
        "any_held": F.max("is_held").over(whole), "first": F.min(F.when(F.col("is_held"), first_held)).over(whole), "s_restocked": F.max("start").over(whole)}).where(day)
    earlier = F.when(F.col("any_held"), F.col("first")["before"]).otherwise(F.col("s_restocked"))
    return run.select("snapshot_date", *KEY, "net", F.col("inbound"), (F.col("run") - F.coalesce("taken", F.lit(0))).cast("bigint").alias("on_hand"),
                      F.greatest("r", earlier).alias("restocked"), F.greatest("rb", earlier).alias("restocked_before"),
                      F.coalesce(year_month(F.col("snapshot_date")), F.lit(NO_MONTH)).cast("int").alias("ym"))


@dataclass
class StockSnapshots:
    """The snapshots of a stream of movements, kept under ``root``: one row per day on which a
    (warehouse, product) moved."""
    spark: SparkSession
    root: str
    max_folders: int = 64

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.root)

    def balance(self, at: Snapshot | None = None) -> DataFrame:
        return merge_balance(self.log.read(BALANCE, BALANCE_DDL, at))

    def first_late_month(self, daily: DataFrame, balance: DataFrame) -> int | None:
        """The month of the earliest day in ``daily`` that is not after its key's last day; None
        if none is. Movements without a time are late for every key that has stored rows. A batch
        that begins after every stored day is told by two small totals; else a key's first day
        meets the last of its balances (any number of them)."""
        day, last = daily.agg(F.min("snapshot_date").alias("d"), F.count_if(F.col("snapshot_date").isNull()).alias("undated")), balance.agg(F.max("last_day").alias("d"), F.count(F.lit(1)).alias("n"))
        new, old = day.first(), last.first()
        if old["n"] == 0 or not new["undated"] and (new["d"] is None or old["d"] is None or new["d"] > old["d"]):
            return None
        none = F.lit(None).cast("date")
        both = daily.select(*KEY, "snapshot_date", none.alias("last_day"), F.col("snapshot_date").isNull().alias("undated"), F.lit(False).alias("known")).unionByName(
            balance.select(*KEY, none.alias("snapshot_date"), "last_day", F.lit(False).alias("undated"), F.lit(True).alias("known")))
        keys = both.groupBy(*KEY).agg(F.min("snapshot_date").alias("d"), F.max("last_day").alias("last"), F.max("undated").alias("undated"), F.max("known").alias("known"))
        late = F.when(F.col("undated"), F.lit(NO_MONTH)).when(F.col("d") <= F.col("last"), year_month(F.col("d")))
        return keys.where("known").agg(F.min(late).alias("m")).first()["m"]

    def update(self, movements: DataFrame, batch_id: int, stream_id: str = "batch", retries: int = 3) -> bool:
        """Add a batch. False if this batch of the stream, or a later one, was added before."""
        log = self.log
        if int(log.snapshot().slots(DONE).get(stream_id, -1)) >= batch_id:
            return False
        daily = stage(daily_net(movements), "daily-net")
        for attempt in range(retries + 1):
            at = log.snapshot()
            if int(at.slots(DONE).get(stream_id, -1)) >= batch_id:
                return False
            balance = log.read(BALANCE, BALANCE_DDL, at)
            late = self.first_late_month(daily, balance)
            replaced = [] if late is None else [s for s in at.slots(ROWS) if int(s.split(".")[0]) >= late]
            rows = running_rows(daily, log.read(ROWS, ROWS_DDL, at, replaced), balance)
            slot, folder = log.new_folder(BALANCE)
            write_layout(balance_of(daily), folder)   # always read whole: no order
            months = self._write_months(log, rows)
            try:
                now = log.commit(at, remove={ROWS: replaced}, add={ROWS: months, BALANCE: {slot: folder}, DONE: {stream_id: str(batch_id)}})
            except CommitConflict:   # another batch came first: what is late may have changed
                if attempt == retries:
                    raise
                continue
            if len(now.slots(BALANCE)) > self.max_folders:
                self.compact(now)
            return True
        return False

    def _write_months(self, log: CommitLog, rows: DataFrame) -> dict[str, str]:
        """Rows written by month; a slot per month, so that a month can be replaced."""
        slot, folder = log.new_folder(ROWS)
        write_layout(rows, folder, partition_by=("ym",), sort_by=("snapshot_date", *KEY))
        names = [n for n, _ in log.files.names(folder) if n.startswith("ym=")]
        return {f"{n[3:]}.{slot}": f"{folder}/{n}" for n in names}

    def compact(self, at: Snapshot | None = None) -> bool:
        """Merge the balances into one, and the folders of every month that has several into one;
        False if another writer came first or there is nothing to merge."""
        log = self.log
        at = at or log.snapshot()
        by_month: dict[str, list[str]] = {}
        for s in at.slots(ROWS):
            by_month.setdefault(s.split(".")[0], []).append(s)
        many = [s for slots in by_month.values() if len(slots) > 1 for s in slots]
        if len(at.slots(BALANCE)) < 2 and not many:
            return False
        slot, folder = log.new_folder(BALANCE)
        write_layout(self.balance(at), folder)
        months = self._write_months(log, log.read(ROWS, ROWS_DDL, at, many)) if many else {}
        try:
            log.commit(at, remove={ROWS: many, BALANCE: list(at.slots(BALANCE))}, add={ROWS: months, BALANCE: {slot: folder}})
        except CommitConflict:
            return False
        return True

    def table(self, at: Snapshot | None = None, reserved: int = 0, reorder_point: int = 0) -> DataFrame:
        """``warehouse_snapshots`` with the types of the model. A quantity beyond its type is null."""
        rows = self.log.read(ROWS, ROWS_DDL, at)
        out = rows.select("snapshot_date", *KEY, F.col("on_hand").try_cast("int").alias("quantity_on_hand"), F.lit(reserved).alias("quantity_reserved"),
                          (F.col("on_hand") - F.lit(reserved)).try_cast("int").alias("quantity_available"), F.col("restocked").alias("last_restock_date"),
                          F.lit(reorder_point).alias("reorder_point"), F.nullif(F.col("ym"), F.lit(NO_MONTH)).alias("ym"))
        return out.select(*[F.col(f.name).cast(f.dataType) for f in TABLES["inventory.warehouse_snapshots"].schema.fields])

    def store(self, path: str) -> None:
        """Write the table in its layout, which is that of the stored rows."""
        spec = TABLES["inventory.warehouse_snapshots"]
        write_layout(self.table(), path, partition_by=spec.partition_by, sort_by=spec.sort_by, bloom=spec.bloom, dealt=True)


def start_snapshot_stream(snapshots: StockSnapshots, movements: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Every micro-batch of a stream of movements is added to the snapshots, once."""
    stream_id = stream_key(checkpoint)
    return (movements.writeStream.foreachBatch(lambda df, n: snapshots.update(df, n, stream_id) and None).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())
