"""Readers for the driver tables and for files the library writes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.write import deal_folders
from ..schemas import TableSpec

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; projections and filters applied later are pushed into it by Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema=None, sampling_ratio: float | None = None) -> DataFrame:
    """JSON-lines directory scan. With ``schema`` there is no inference pass (the
    default to use at scale); without it the schema is inferred as the reference does,
    from all rows or from the fraction ``sampling_ratio`` of them."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif sampling_ratio is not None:
        reader = reader.option("samplingRatio", str(sampling_ratio))
    return reader.json(path)


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The facade of a sharded table: every row of every shard (UNION ALL, duplicates kept)."""
    frames = [spark.read.parquet(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shard_of(key: list[Column], n_shards: int) -> Column:
    """The shard of a key. On literals it is folded to a constant when the query is planned."""
    return F.pmod(F.xxhash64(*key), F.lit(n_shards)).cast("int")


@dataclass
class ShardedTable:
    """S07 + K17: one table dealt to shards by the hash of a key, in its own layout inside each
    shard. The shard is a partition column, so readers who give the key list one shard only."""
    spark: SparkSession
    root: str
    spec: TableSpec
    key: tuple[str, ...]
    n_shards: int

    def write(self, df: DataFrame, mode: str = "overwrite", keys: DataFrame | None = None) -> None:
        """Replace all shards (or append to them), each sorted by the table's sort key. Files
        are dealt by (shard, partition, sort key): a hot shard or month is many tasks' work.
        ``keys``: a cheaper frame with the keys of a derived ``df`` (see ``deal_folders``)."""
        df, keys = [x and x.withColumn("shard", shard_of([F.col(c) for c in self.key], self.n_shards)) for x in (df, keys)]
        out = deal_folders(df, ["shard", *self.spec.partition_by], list(self.spec.sort_by), keys)
        w = out.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("shard", *self.spec.partition_by)
        for col, ndv in self.spec.bloom.items():
            w = w.option(f"parquet.bloom.filter.enabled#{col}", "true").option(f"parquet.bloom.filter.expected.ndv#{col}", str(ndv))
        w.parquet(self.root)

    def _scan(self) -> DataFrame:
        return self.spark.read.parquet(self.root)

    def read(self) -> DataFrame:
        """Every row of every shard, as stored (repeated rows are kept)."""
        return self._scan().drop("shard")

    def lookup(self, *values) -> DataFrame:
        """The rows of one key; the others' shards are not listed. A null is a value here."""
        scan = self._scan()
        lits = [F.lit(v).cast(scan.schema[c].dataType) for c, v in zip(self.key, values, strict=True)]
        same = [F.col(c).eqNullSafe(v) if x is None else F.col(c) == v for c, v, x in zip(self.key, lits, values)]
        return scan.where(reduce(Column.__and__, same, F.col("shard") == shard_of(lits, self.n_shards))).drop("shard")

    def join_keys(self, keys: DataFrame, how: str = "left_semi") -> DataFrame:
        """The rows whose key is among ``keys`` (columns named like the key). The shard is part of
        the join: where Spark broadcasts a filtered key side, its dynamic partition pruning skips
        shards that no key hashes to; else shards and keys meet by a shuffle. Null keys match nothing."""
        scan = self._scan()
        keys = keys.select(*[F.col(c).cast(scan.schema[c].dataType).alias(c) for c in self.key]).distinct()
        keys = keys.withColumn("shard", shard_of([F.col(c) for c in self.key], self.n_shards))
        return scan.join(keys, ["shard", *self.key], how).drop("shard")
