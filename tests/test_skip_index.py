"""The skip index names all files with matches, and few others."""

import datetime as dt

from pyspark.sql import functions as F

from quayside.operators.skip_index import build_skip_index, files_that_may_match, read_matching
from quayside.operators.write import write_layout
from quayside.session import scratch_dir

KINDS = {"d": ("minmax",), "t": ("set", 5), "many": ("set", 3), "s": ("bloom", 1 << 18), "p": ("minmax",)}


def test_files_are_chosen_before_the_scan(spark):
    path = scratch_dir(spark, "skip")
    rows = spark.range(8000).select(
        F.col("id").alias("d"), F.floor(F.col("id") / 1000).cast("string").alias("t"), (F.col("id") % 97).cast("string").alias("many"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("sku-"), "id")).alias("s"), F.when(F.col("id") >= 4000, F.col("id") * 2).cast("decimal(18,2)").alias("p"),
        F.when(F.col("id") < 6000, 1).otherwise(2).alias("ym"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_layout(rows, path, partition_by=("ym",), sort_by=("d",))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    index = f"{path}_index"
    build_skip_index(spark, path, index, KINDS)
    build_skip_index(spark, path, index, KINDS)   # again: replaces the former
    whole = spark.read.parquet(path)
    n = len(whole.inputFiles())
    assert n > 3
    asked = [
        ([("eq", "s", "sku-4242")], 1), ([("eq", "s", "absent")], 0), ([("in", "s", ["sku-1", "sku-7999"])], 2),
        ([("between", "d", 10, 20)], 1), ([("le", "d", -1)], 0), ([("le", "d", 5)], 1), ([("eq", "d", 5000)], 1),
        ([("in", "t", ["0", "7"])], 2 * 2), ([("eq", "t", "9")], 0), ([("eq", "many", "5")], n), ([("le", "p", 8100)], n - 1),
        ([("between", "d", 10, 4500), ("eq", "s", "sku-4242")], 1), ([("eq", "ym", 2)], n)]
    for predicates, most in asked:
        files = files_that_may_match(spark, index, KINDS, predicates)
        got = read_matching(spark, path, index, KINDS, predicates)
        cond = " AND ".join({"eq": "{} = {!r}", "in": "{} IN {}", "between": "{} BETWEEN {} AND {}", "le": "{} <= {}"}[op].format(c, *(tuple(x) if isinstance(x, list) else x for x in v))
                            for op, c, *v in predicates)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.where(cond).collect())), predicates
        assert len(files) <= most and (not files or {f.replace("file:///", "file:/") for f in got.inputFiles()} == set(files)), predicates


def test_types_of_the_model(spark):
    path = scratch_dir(spark, "skip-types")
    at = dt.date(2024, 1, 1)
    spark.createDataFrame([(at, 1.5), (dt.date(2024, 2, 1), None)], "day date, x double").write.parquet(path)
    kinds = {"day": ("minmax",), "x": ("minmax",)}
    build_skip_index(spark, path, f"{path}_i", kinds)
    assert read_matching(spark, path, f"{path}_i", kinds, [("between", "day", at, at), ("le", "x", 2.0)]).count() == 1
    assert read_matching(spark, path, f"{path}_i", kinds, [("le", "x", 1.0)]).count() == 0
