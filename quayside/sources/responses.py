"""Recorded API responses, the input of every decoder.

One row per HTTP response: ``(endpoint, symbol, depth, status, retry_after, used_weight,
body, fetched_at)``. Always read with the fixed schema (no inference pass)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import RESPONSE_DDL


def read_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Batch read of recorded responses stored as JSON lines or Parquet."""
    if fmt == "parquet":
        return spark.read.schema(RESPONSE_DDL).parquet(path)
    return spark.read.schema(RESPONSE_DDL).json(path)


def stream_responses(spark: SparkSession, path: str, fmt: str = "json",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """The same rows as a stream of arriving files (one micro-batch takes at most
    ``max_files_per_trigger`` new files)."""
    r = spark.readStream.schema(RESPONSE_DDL).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)
