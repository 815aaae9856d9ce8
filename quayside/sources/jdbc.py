"""Relational scan through JDBC, split into parallel range reads.

The driver package comes from the session configuration. Projection and filters
applied to the result are pushed into the generated SQL by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              num_partitions: int = 8, lower: int | None = None, upper: int | None = None,
              properties: dict | None = None, fetchsize: int = 10_000) -> DataFrame:
    """Parallel read: ``num_partitions`` range queries on ``partition_column``. Bounds are
    read from the table (one tiny min/max query) when not given."""
    props = dict(properties or {})
    props.setdefault("fetchsize", str(fetchsize))
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=props)
    if lower is None or upper is None:
        b = spark.read.jdbc(url, f"(SELECT min({partition_column}) AS lo, max({partition_column}) AS hi "
                                 f"FROM {table}) AS bounds", properties=props).first()
        lower, upper = (b["lo"] or 0), (b["hi"] or 0)
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=int(lower), upperBound=int(upper) + 1,
                           numPartitions=num_partitions, properties=props)
