"""A sidecar that says which files of a table may match a predicate.

Per file it holds, for the columns asked for: the smallest and largest value (``minmax``), the
distinct values if they are few (``set``), or a bitmap of hashed values (``bloom``: one bit per
value in as many bits as are given, so values that a file lacks are told apart with about
values / bits exceptions). Predicates are answered on the sidecar first, and only the files
that it cannot rule out are opened. Built by aggregates that are partial inside the tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BITS_PER_ROW = 1 << 15   # Spark's bitmaps


def _hashed(col: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(bits))


def build_skip_index(spark: SparkSession, path: str, index_path: str, columns: dict[str, tuple]) -> None:
    """Write the sidecar of the Parquet table at ``path``. ``columns``: name to ``("minmax",)``,
    ``("set", most values)`` or ``("bloom", bits)``. A file with more values than a set may
    hold keeps none and is never ruled out by it; an all-null column rules its file out."""
    rows = spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("file"))
    ranged = [c for c, k in columns.items() if k[0] == "minmax"]
    out = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{n}_{c}") for c in ranged for n, f in (("min", F.min), ("max", F.max))))
    for c, kind in columns.items():
        if kind[0] == "set":
            values = rows.groupBy("file", F.col(c).alias("v")).agg(F.lit(1).alias("one")).where("v is not null")
            few = values.groupBy(F.col("file").alias("f")).count().where(F.col("count") <= kind[1])
            held = values.join(few, F.col("file") == F.col("f")).groupBy(F.col("file").alias("s_file")).agg(F.collect_list("v").alias(f"set_{c}"))
            known = rows.groupBy(F.col("file").alias("n_file")).agg((F.count(c) == 0).alias(f"none_{c}"))
            out = out.join(held, F.col("file") == F.col("s_file"), "left").drop("s_file").join(known, F.col("file") == F.col("n_file")).drop("n_file")
    out.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{index_path}/files")
    maps = []
    for c, kind in columns.items():
        if kind[0] == "bloom":
            h = _hashed(F.col(c), -(-kind[1] // _BITS_PER_ROW) * _BITS_PER_ROW)
            maps.append(rows.where(F.col(c).isNotNull()).groupBy("file", F.bitmap_bucket_number(h).alias("part"))
                        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits")).withColumn("name", F.lit(c)))
    if maps:
        (reduce(DataFrame.unionByName, maps).write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy("name").parquet(f"{index_path}/bitmaps"))


def _condition(p: tuple) -> Column:
    op, c, *v = p
    return {"eq": lambda: F.col(c) == v[0], "in": lambda: F.col(c).isin(list(v[0])), "between": lambda: F.col(c).between(v[0], v[1]),
            "le": lambda: F.col(c) <= v[0]}[op]()


def files_that_may_match(spark: SparkSession, index_path: str, columns: dict[str, tuple], predicates: list[tuple]) -> list[str]:
    """Files that no predicate rules out. Predicates, all of which must hold: ``("eq", column,
    value)``, ``("in", column, values)``, ``("between", column, low, high)``, ``("le", column, value)``."""
    files = spark.read.parquet(f"{index_path}/files")
    for op, c, *v in predicates:
        kind, *size = columns.get(c, ("none",))
        wanted = [v[0]] if op == "eq" else list(v[0]) if op == "in" else None
        low, high = (F.col(f"min_{c}"), F.col(f"max_{c}")) if kind == "minmax" else (None, None)
        if kind == "minmax":
            near = (reduce(lambda a, b: a | b, [F.lit(x).between(low, high) for x in wanted], F.lit(False)) if wanted is not None
                    else (low <= v[1]) & (high >= v[0]) if op == "between" else low <= v[0])
            files = files.where(near)
        elif kind == "set" and wanted is not None:
            files = files.where(~F.col(f"none_{c}") & (F.col(f"set_{c}").isNull() | F.arrays_overlap(F.col(f"set_{c}"), F.array(*map(F.lit, wanted)))))
        elif kind == "bloom" and wanted is not None:
            bits = -(-size[0] // _BITS_PER_ROW) * _BITS_PER_ROW
            maps = spark.read.parquet(f"{index_path}/bitmaps").where(F.col("name") == c)
            hits = []
            for x in wanted:
                h = _hashed(F.lit(x), bits)
                pos = F.bitmap_bit_position(h)
                byte = F.conv(F.hex(F.substring("bits", (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
                hits.append((F.col("part") == F.bitmap_bucket_number(h)) & (F.floor(byte / F.pow(F.lit(2), pos % 8)) % 2 == 1))
            files = files.join(maps.where(reduce(lambda a, b: a | b, hits)).select("file"), "file", "left_semi")
    return sorted(r[0] for r in files.select("file").collect())   # names of files, as a scan lists them


def read_matching(spark: SparkSession, path: str, index_path: str, columns: dict[str, tuple], predicates: list[tuple]) -> DataFrame:
    """The rows that fulfil all predicates, from the files that may hold some."""
    names = files_that_may_match(spark, index_path, columns, predicates)
    whole = spark.read.parquet(path)
    some = spark.read.schema(whole.schema).option("basePath", path).parquet(*names).select(*whole.columns) if names else whole.limit(0)
    return some.where(reduce(lambda a, b: a & b, map(_condition, predicates)))
