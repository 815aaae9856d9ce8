"""Write semantics: upsert, insert-if-absent, high-water marks, header/detail, append,
partitioned and sharded layouts, versioned tables and idempotent bootstrap.

Parquet tables in the session catalog have no MERGE and cannot be overwritten while
being read, so a rewrite (upsert) produces a *new version folder*; readers follow the
newest version of the commit log. Appends (insert-if-absent, plain append) write new files
only. Task retries never duplicate rows (Spark's commit protocol publishes a task's
files once). The writes the ingestion and streaming jobs repeat are idempotent:
insert-if-absent, version commits and per-batch partition overwrites. Plain append
(K11) appends again when called again, by definition.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import year_month
from ..schemas import TABLES, TableSpec
from ..session import stage
from .commit_log import CommitConflict, CommitLog, Snapshot  # noqa: F401


# --------------------------------------------------------------------------- keep first / last

def _pick(df: DataFrame, key: list[str], ord_col: str, last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if last else F.min_by
    # max_by / min_by aggregate partially before the shuffle, so a key repeated
    # millions of times is reduced map-side, not in one task.
    return (df.groupBy(*key).agg(pick(F.struct(*rest), F.col(ord_col)).alias("_r"))
              .select(*key, "_r.*"))


def keep_last(df: DataFrame, key: list[str], ord_col: str) -> DataFrame:
    """Last row per key by an explicit ordinal (statements applied in order: last wins)."""
    return _pick(df, key, ord_col, last=True)


def keep_first(df: DataFrame, key: list[str], ord_col: str) -> DataFrame:
    """First row per key by an explicit ordinal (insert-ignore inside one batch)."""
    return _pick(df, key, ord_col, last=False)


# --------------------------------------------------------------------------- K06 upsert

def upsert(target: DataFrame, batch: DataFrame, key: list[str], ord_col: str | None,
           refresh: dict[str, Column] | None = None) -> DataFrame:
    """``ON CONFLICT (key) DO UPDATE``: the last batch row per key replaces the stored
    row; untouched rows stay. ``refresh`` sets columns such as ``fetched_at = now()``.
    ``ord_col=None`` declares the batch unique per key already (no keep-last aggregate)."""
    latest = keep_last(batch, key, ord_col).drop(ord_col) if ord_col else batch
    for name, expr in (refresh or {}).items():
        latest = latest.withColumn(name, expr)
    latest = latest.select(*target.columns)
    kept = target.join(latest.select(*key), on=key, how="left_anti")
    return kept.unionByName(latest)


# --------------------------------------------------------------------------- K07 insert-ignore

@dataclass
class InsertResult:
    inserted: DataFrame      # rows new to the target, in target column order
    metrics: DataFrame       # K12: (symbol-or-group, attempted, inserted)


def insert_ignore(target: DataFrame | None, batch: DataFrame, key: list[str], ord_col: str,
                  group_col: str = "symbol", prune_col: str | None = None,
                  range_col: str | None = None) -> InsertResult:
    """``ON CONFLICT DO NOTHING``: an existing row wins, then the first duplicate of the
    batch.

    The target is probed only where the batch can collide. Both ways to narrow it must be
    key columns, because a stored row with the same key may differ in every other column
    (a month derived from the time, say): ``prune_col`` keeps the partitions the batch
    touches, ``range_col`` (e.g. the trade id) keeps rows inside the batch's [min, max],
    which row-group statistics turn into skipped row groups."""
    for c in (prune_col, range_col):
        if c and c not in key:
            raise ValueError(f"{c} is no key column: a stored key could be missed")
    first = keep_first(batch, key, ord_col)
    if target is not None:
        probe = target
        bounds = []
        if prune_col:
            bounds.append(F.collect_set(prune_col).alias("_parts"))
        if range_col:
            bounds += [F.min(range_col).alias("_lo"), F.max(range_col).alias("_hi")]
        if bounds:
            b = batch.agg(*bounds).first()
            if prune_col:
                probe = probe.filter(F.col(prune_col).isin(list(b["_parts"] or [])))
            if range_col and b["_lo"] is not None:
                probe = probe.filter(F.col(range_col).between(b["_lo"], b["_hi"]))
        new = first.join(probe.select(*key), on=key, how="left_anti")
    else:
        new = first
    return InsertResult(new, write_metrics(batch, new, group_col))


def write_metrics(batch: DataFrame, inserted: DataFrame, group_col: str = "symbol") -> DataFrame:
    """Rows attempted and rows inserted per group, one small aggregate per side."""
    attempted = batch.groupBy(group_col).agg(F.count(F.lit(1)).alias("attempted"))
    done = inserted.groupBy(group_col).agg(F.count(F.lit(1)).alias("inserted"))
    return attempted.join(done, on=group_col, how="left").select(
        group_col, "attempted", F.coalesce("inserted", F.lit(0)).cast("bigint").alias("inserted"))


# --------------------------------------------------------------------------- K08 marks

def high_water_marks(trades: DataFrame, worker_type: str = "agg_trades", id_col: str = "agg_trade_id",
                     time_col: str = "trade_time") -> DataFrame:
    """Per symbol, the largest id and the time of that row."""
    return trades.groupBy("symbol").agg(
        F.max(id_col).alias("last_id"), F.max_by(time_col, id_col).alias("last_timestamp")
    ).select(F.lit(worker_type).alias("worker_type"), "symbol", "last_id", "last_timestamp",
             F.localtimestamp().alias("updated_at"))


def advance_marks(state: DataFrame, marks: DataFrame, monotone: bool = False) -> DataFrame:
    """Upsert new marks into the state table. ``monotone=False`` is the reference's rule
    (the new mark always overwrites, even when lower); ``True`` never moves backwards."""
    key = ["worker_type", "symbol"]
    if monotone:
        old = state.select(*key, F.col("last_id").alias("_old_id"), F.col("last_timestamp").alias("_old_ts"))
        marks = marks.join(old, on=key, how="left").select(
            *key,
            F.greatest("last_id", "_old_id").alias("last_id"),
            F.when(F.col("_old_id").isNull() | (F.col("last_id") >= F.col("_old_id")), F.col("last_timestamp"))
             .otherwise(F.col("_old_ts")).alias("last_timestamp"),
            "updated_at")
    return upsert(state, marks, key, None)   # one mark per key by construction


# --------------------------------------------------------------------------- storage

def ensure_table(spark: SparkSession, path: str, schema, partition_by: tuple[str, ...] = ()) -> None:
    """Create the folder of a Parquet table if it does not exist (an empty append: writes no
    rows, idempotent), so later reads with an explicit schema never hit a missing path."""
    w = spark.createDataFrame([], schema).write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or no rows if its folder does not exist yet. Reading never writes."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class VersionedTable:
    """A table whose rewrites go to new folders of their own. A version becomes current when
    its file lands in the commit log, which happens only after its data files are complete:
    a rewrite that dies half-way leaves the previous version current. The file is put only
    if absent, so a committed version is never displaced; the writer that comes second gets
    :class:`CommitConflict` and its data never count."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root)
        self.root = self.log.root
        self._known: Snapshot | None = None   # version this object committed or last saw

    def versions(self) -> list[int]:
        return self.log.versions()

    def _seen(self, refresh: bool = False) -> Snapshot:
        if self._known is None or refresh:
            self._known = self.log.snapshot()
        return self._known

    def current_version(self, refresh: bool = False) -> int | None:
        """Newest committed version. The log is read once per object; later calls reuse the
        number this object committed or saw (``refresh=True`` re-reads it, for tables that
        another writer may have advanced meanwhile)."""
        return self._seen(refresh).version or None

    def current_path(self) -> str | None:
        return self._seen().slots("data").get("current")

    def read(self, schema=None) -> DataFrame | None:
        path = self.current_path()
        if path is None:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(path)

    def commit(self, df: DataFrame, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> str:
        """Write the next version after the one this object last read (or committed). If
        another writer took that version, the rewrite would lose its rows, so it fails."""
        seen = self._seen()
        if self.log.snapshot().version != seen.version:
            raise CommitConflict(f"version {seen.version + 1} of {self.root} exists: read the table again")
        _, path = self.log.new_folder("data")
        write_layout(df, path, partition_by=partition_by, sort_by=sort_by)
        self._known = self.log.commit(seen, replace={"data": {"current": path}})
        return path


# --------------------------------------------------------------------------- K14 / K15 layout

def add_month(df: DataFrame, ts_col: str, name: str = "ym") -> DataFrame:
    return df.withColumn(name, year_month(F.col(ts_col)))


RANGE_ROWS = (250_000, 2_000_000)   # least and most rows that a task is dealt, as far as folders and keys allow


def deal_folders(df: DataFrame, folders: list[str], sort_by: list[str], keys: DataFrame | None = None,
                 rows: int | None = None) -> DataFrame:
    """Rows dealt to tasks by folder (the values of ``folders``), those of a large folder by
    ranges of the sort key too, and sorted in each task.

    Range partitioning samples its whole input first, so all of a derived table is worked out
    twice. Here folders are counted, and large ones sampled, on their columns and the sort key
    alone. ``keys`` replaces ``df`` in this where its rows are unique by sort key: a cheaper
    frame with the same (folder, sort key) values, repeats allowed. Counts and bounds only
    choose a row's task, never whether it is written. A task gets about ``rows`` rows, by
    default a few tasks for each core within ``RANGE_ROWS``."""
    spark, seen, key = df.sparkSession, df if keys is None else keys, F.struct(*sort_by)

    def same(plan: DataFrame) -> Column:
        return reduce(Column.__and__, [F.col(c).eqNullSafe(plan[f"_of_{c}"]) for c in folders])

    n = F.count(F.lit(1)) if keys is None else F.approx_count_distinct(F.xxhash64(*sort_by))
    found = stage(seen.groupBy(*[F.col(c).alias(f"_of_{c}") for c in folders]).agg(n.alias("_n")), "folders")
    names = [f"_of_{c}" for c in folders]
    if rows is None:
        total = found.agg(F.sum("_n")).first()[0] or 0
        rows = min(max(total // (4 * spark.sparkContext.defaultParallelism), RANGE_ROWS[0]), RANGE_ROWS[1])
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)   # one row a folder
    plan = found.select(*names, F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows).alias("_base"),
                        F.greatest(F.ceil(F.col("_n") / rows), F.lit(1)).alias("_cuts"))
    size = plan.agg(F.max(F.col("_base") + F.col("_cuts")).alias("tasks"), F.max("_cuts").alias("cuts")).first()
    place, rest = F.lit(0), df
    if (size["cuts"] or 1) > 1:
        large, thin = plan.where("_cuts > 1"), max(1, rows // 64)   # 64 keys a range
        some = seen.sample(1.0 / thin, seed=1) if keys is None else seen.where(F.pmod(F.xxhash64(*sort_by), F.lit(thin)) == 0)
        some = some.join(F.broadcast(large), same(large)).select(*large.columns, key.alias("_key"))
        some = some if keys is None else some.distinct()
        bounds = some.groupBy(*names, "_cuts").agg(F.sort_array(F.collect_list("_key")).alias("_keys"))
        at = F.sequence(F.lit(1), F.col("_cuts").cast("int") - 1)
        bounds = bounds.select(*[F.col(c).alias(c[4:]) for c in names], F.transform(
            at, lambda i: F.get("_keys", F.floor(i * F.size("_keys") / F.col("_cuts")).cast("int"))).alias("_bounds"))
        plan = stage(plan.join(F.broadcast(bounds), same(plan), "left").select(*plan.columns, "_bounds"), "folder-bounds")
        # binary search: the number of bounds not above the row's key
        steps = F.array(*[F.lit(1 << j) for j in reversed(range(int(size["cuts"]).bit_length()))])
        place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= F.size("_bounds")) & (F.get("_bounds", at + step - 1) <= F.col("_key")), at + step).otherwise(at))
        place = F.when(F.col("_bounds").isNull(), 0).otherwise(place)
        rest = df.withColumn("_key", key)
    out = rest.join(F.broadcast(plan), same(plan), "left")
    out = out.select(*df.columns, F.coalesce(F.col("_base") + place, F.lit(0)).cast("int").alias("_task"))
    return out.repartitionById(size["tasks"] or 1, "_task").sortWithinPartitions(*folders, *sort_by).drop("_task")


def write_layout(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (),
                 bloom: dict | None = None, mode: str = "overwrite", max_records_per_file: int | None = None,
                 fmt: str = "parquet", dealt: bool = False, keys: DataFrame | None = None) -> None:
    """Month (or flag) partitions, rows sorted by the table's key inside each file.

    Range-partitioning on (partition columns, sort key) gives each task one contiguous
    key range: a big month is spread over many tasks (never one task per month), every
    file is sorted, and row-group min/max statistics prune key and time ranges. Bloom
    filters are written for the columns in ``bloom`` (value = expected distinct count).
    ``dealt`` rows are read from files of this layout: they are sorted, not dealt again.
    ``keys`` (see :func:`deal_folders`) spares a derived table from being worked out twice."""
    order = [*partition_by, *sort_by]
    if keys is not None:
        out = deal_folders(df, list(partition_by), list(sort_by), keys)
    else:
        out = (df if dealt else df.repartitionByRange(*order)).sortWithinPartitions(*order) if order else df
    # a full overwrite replaces all partitions, whatever the session's overwrite mode is
    w = out.write.mode(mode).format(fmt).option("partitionOverwriteMode", "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    for col, ndv in (bloom or {}).items():
        w = w.option(f"parquet.bloom.filter.enabled#{col}", "true") \
             .option(f"parquet.bloom.filter.expected.ndv#{col}", str(ndv))
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(max_records_per_file))
    w.save(path)


def write_table(df: DataFrame, path: str, spec: TableSpec, mode: str = "overwrite") -> None:
    write_layout(df, path, partition_by=spec.partition_by, sort_by=spec.sort_by, bloom=spec.bloom, mode=mode)


def month_filter(ts_col: str, start, end, ym_col: str = "ym") -> Column:
    """Time range plus the matching ``ym`` range, so partition pruning applies."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return (F.col(ts_col).between(s, e)
            & F.col(ym_col).between(year_month(s), year_month(e)))


# --------------------------------------------------------------------------- K17 shards

def write_shards(df: DataFrame, root: str, key: list[str], n_shards: int) -> list[str]:
    """Every row to shard ``pmod(xxhash64(key), n)``. A hash rather than ``rand()`` so a
    retried task writes the same rows to the same shard."""
    shard = F.pmod(F.xxhash64(*key), F.lit(n_shards))
    (df.withColumn("shard", shard).write.mode("overwrite").option("partitionOverwriteMode", "static")
       .partitionBy("shard").parquet(root))
    paths = [f"{root}/shard={i}" for i in range(n_shards)]
    for p in paths:   # a shard that got no row must still be readable
        ensure_table(df.sparkSession, p, df.schema)
    return paths


# --------------------------------------------------------------------------- K13 bootstrap

DEFAULT_NOW = {"app.events": ("created_at",), "crypto.symbols": ("fetched_at",),
               "crypto.agg_trades": ("inserted_at",), "crypto.orderbook_snapshots": ("snapshot_time",),
               "crypto.ticker_24hr": ("fetched_at",), "crypto.ingest_state": ("updated_at",)}


def _ddl_with_defaults(spec: TableSpec) -> str:
    cols = []
    now_cols = DEFAULT_NOW.get(spec.qualified, ())
    for f in spec.schema.fields:
        c = f"{f.name} {f.dataType.simpleString()}"
        if f.name in spec.max_length:
            c = f"{f.name} varchar({spec.max_length[f.name]})"
        if f.name in now_cols:
            c += " DEFAULT localtimestamp()"  # one time for the whole statement
        cols.append(c)
    return ", ".join(cols)


def bootstrap(spark: SparkSession, root: str, prefix: str = "", tables: dict[str, TableSpec] | None = None) -> list[str]:
    """``CREATE DATABASE/TABLE IF NOT EXISTS`` for every table; running it again changes
    nothing. Tables are external Parquet tables under ``root``."""
    made = []
    for spec in (tables or TABLES).values():
        db = f"{prefix}{spec.database}"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{root}/{db}.db'")
        part = f" PARTITIONED BY ({', '.join(spec.partition_by)})" if spec.partition_by else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.{spec.name} ({_ddl_with_defaults(spec)}) USING parquet"
                  f"{part} LOCATION '{root}/{db}.db/{spec.name}'")
        made.append(f"{db}.{spec.name}")
    return made


def replace_table(df: DataFrame, name: str, path: str) -> None:
    """Create-or-replace a catalog table from a DataFrame (session catalog: overwrite the
    table definition and its files; on a DataSource-V2 catalog ``writeTo().createOrReplace()``)."""
    df.write.mode("overwrite").option("path", path).saveAsTable(name)


def observed_append(df: DataFrame, path: str, name: str, partition_by: tuple[str, ...] = ()) -> dict:
    """Append and report the row count seen by the write itself (no extra pass)."""
    obs = Observation(name)
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return obs.get


# --------------------------------------------------------------------------- per-batch writes

def stream_key(checkpoint: str) -> str:
    """Name of a stream's rows in a table: a hash of its checkpoint path. Batch numbers start
    again with a new checkpoint, so a batch is only known by both."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def write_batch_partition(df: DataFrame, path: str, batch_id: int, stream_id: str,
                          partition_by: tuple[str, ...] = ()) -> None:
    """Idempotent append for streaming micro-batches: rows land under
    ``stream_id=S/batch_id=N``. A re-run of batch N of the same stream (at-least-once replay
    after a failure) replaces exactly that partition; other streams, and the same stream
    started on a new checkpoint, never touch it."""
    (df.withColumn("stream_id", F.lit(stream_id)).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("stream_id", "batch_id", *partition_by).parquet(path))


def write_header_detail(headers: DataFrame, levels: DataFrame, root: str, batch_id: int, stream_id: str) -> None:
    """Headers and their levels from one decoded input. Both carry the hashed
    ``snapshot_id``; headers are written even when they have no levels."""
    write_batch_partition(headers, f"{root}/orderbook_snapshots", batch_id, stream_id)
    write_batch_partition(levels, f"{root}/orderbook_levels", batch_id, stream_id)


# --------------------------------------------------------------------------- bucketed tables

def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: tuple[str, ...]) -> None:
    """A catalog table hash-bucketed and sorted on ``key``: two tables bucketed alike on the
    join key join without a shuffle on either side. Rows are first hash-partitioned into
    ``buckets`` tasks (the same hash as bucketing), so each task writes one file per bucket
    instead of every task writing a file into every bucket."""
    (df.repartition(buckets, *key).write.mode("overwrite").option("path", path)
       .bucketBy(buckets, *key).sortBy(*key).saveAsTable(name))


# --------------------------------------------------------------------------- partition-scoped upsert

def upsert_partitions(spark: SparkSession, path: str, batch: DataFrame, key: list[str], ord_col: str,
                      partition_col: str, refresh: dict[str, Column] | None = None) -> list:
    """K06 for large partitioned tables: upsert only inside the partitions the batch touches.

    The touched partitions are read, upserted, staged in the shared checkpoint folder
    (a table cannot be overwritten while it is being read), then written back with
    dynamic partition overwrite: untouched partitions are never read or rewritten.
    The key must determine the partition (e.g. a trade's month). Returns the partition
    values rewritten."""
    touched = [r[0] for r in batch.select(partition_col).distinct().collect()]   # a few months
    schema = batch.drop(ord_col).schema if ord_col else batch.schema
    for name, expr in (refresh or {}).items():
        schema = batch.drop(ord_col).withColumn(name, expr).schema
    ensure_table(spark, path, schema, (partition_col,))
    current = spark.read.schema(schema).parquet(path).filter(F.col(partition_col).isin(touched))
    merged = upsert(current, batch, key, ord_col, refresh)
    staged = stage(merged, "upsert")
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(partition_col).parquet(path))
    return touched
