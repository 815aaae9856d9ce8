"""Data-quality jobs: constraint report (P08/P09), threshold report (A06), list filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_list
from ..schemas import TableSpec


def include_exclude(df: DataFrame, col: str, include: str | None, exclude: str | None) -> DataFrame:
    """Keep values in the include list (if given), then drop those in the exclude list.
    Lists are comma-separated text; items are trimmed."""
    inc, exc = parse_list(include), parse_list(exclude)
    out = df
    if inc:
        out = out.filter(F.col(col).isin(inc))
    if exc:
        out = out.filter(F.col(col).isNull() | ~F.col(col).isin(exc))
    return out


def validate(df: DataFrame, table: str, not_null=(), max_length: dict | None = None, allowed: dict | None = None,
             key=(), parent: DataFrame | None = None, foreign_key=()) -> DataFrame:
    """Violation counts per rule, as rows ``(table_name, rule, violations)``.

    Column rules are counted in one pass (``count_if`` per rule); the unique-key rule is one
    aggregate on the key (extra rows beyond the first per key); the orphan rule is a
    left-anti join to the parent table."""
    checks = []
    for c in not_null:
        checks.append((f"not_null:{c}", F.col(c).isNull()))
    for c, n in (max_length or {}).items():
        checks.append((f"max_length:{c}<={n}", F.length(c) > n))
    for c, vals in (allowed or {}).items():
        checks.append((f"allowed:{c}", F.col(c).isNotNull() & ~F.col(c).isin(list(vals))))
    parts = []
    if checks:
        one = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, cond) in enumerate(checks)])
        stack = ", ".join(f"'{name}', c{i}" for i, (name, _) in enumerate(checks))
        parts.append(one.selectExpr(f"stack({len(checks)}, {stack}) AS (rule, violations)"))
    if key:
        dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        parts.append(dup.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
                     .select(F.lit(f"unique:{','.join(key)}").alias("rule"), "violations"))
    if parent is not None:
        # rows whose foreign key has no parent row (same column names on both sides)
        orphans = df.join(parent.select(*foreign_key), on=list(foreign_key), how="left_anti")
        parts.append(orphans.agg(F.count(F.lit(1)).alias("violations"))
                     .select(F.lit("orphan").alias("rule"), "violations"))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.lit(table).alias("table_name"), "rule", F.col("violations").cast("bigint").alias("violations"))


def split_valid(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """P08/P09 before a write: rows that pass every per-row rule of ``spec`` (NOT NULL,
    length limit, allowed values), and the others with the first rule they break. Pure
    per-row filters: no shuffle. Key uniqueness needs an aggregate and is left to
    ``validate`` or to insert-if-absent."""
    broken = None
    for c in spec.not_null:
        broken = _first(broken, F.col(c).isNull(), f"not_null:{c}")
    for c, n in spec.max_length.items():
        broken = _first(broken, F.length(c) > n, f"max_length:{c}<={n}")
    for c, vals in spec.allowed.items():
        broken = _first(broken, F.col(c).isNotNull() & ~F.col(c).isin(list(vals)), f"allowed:{c}")
    if broken is None:
        return df, df.limit(0).withColumn("rule", F.lit(None).cast("string"))
    tagged = df.withColumn("_rule", broken)
    return (tagged.filter(F.col("_rule").isNull()).drop("_rule"),
            tagged.filter(F.col("_rule").isNotNull()).withColumnRenamed("_rule", "rule"))


def _first(acc, cond, name):
    return F.when(cond, F.lit(name)) if acc is None else acc.when(cond, F.lit(name))


def validate_spec(df: DataFrame, spec: TableSpec, parent: DataFrame | None = None, foreign_key=()) -> DataFrame:
    """Every rule that a table's definition states, and the foreign key if a parent is given."""
    return validate(df, spec.qualified, not_null=spec.not_null, max_length=spec.max_length,
                    allowed=spec.allowed, key=spec.key, parent=parent, foreign_key=foreign_key)


def threshold_report(checks: list[tuple[str, DataFrame, str, int]]) -> DataFrame:
    """``(check_name, actual, minimum, status)`` per check plus an ``ALL`` row whose
    status is PASS only if every check passes.

    A check is ``(name, one_row_df, column, minimum)``. Checks reading the same one-row
    aggregate are produced by one ``stack`` over that row, so every source appears once
    in the plan and is computed once. The verdict is folded over the collected check
    rows, whose number is the number of checks."""
    by_source: dict[int, tuple[DataFrame, list]] = {}
    for name, df, col, minimum in checks:
        by_source.setdefault(id(df), (df, []))[1].append((name, col, minimum))
    rows = []
    for df, items in by_source.values():
        cells = ", ".join(f"'{n}', CAST(`{c}` AS BIGINT), CAST({int(m)} AS BIGINT)" for n, c, m in items)
        rows.append(df.selectExpr(f"stack({len(items)}, {cells}) AS (check_name, actual, minimum)"))
    allc = reduce(DataFrame.unionByName, rows).withColumn(
        "status", F.when(F.col("actual") >= F.col("minimum"), "PASS").otherwise("FAIL"))
    folded = allc.agg(F.collect_list(F.struct("check_name", "actual", "minimum", "status")).alias("rs"))
    passed = F.aggregate("rs", F.lit(0).cast("bigint"),
                         lambda acc, r: acc + F.when(r["status"] == "PASS", 1).otherwise(0).cast("bigint"))
    overall = F.struct(F.lit("ALL").alias("check_name"), passed.alias("actual"),
                       F.size("rs").cast("bigint").alias("minimum"),
                       F.when(passed == F.size("rs"), "PASS").otherwise("FAIL").alias("status"))
    return folded.select(F.inline(F.concat("rs", F.array(overall))))
