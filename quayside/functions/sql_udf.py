"""``factorial(n)`` as a SQL function (a SQL lambda body, no Python at run time).

The product is folded over ``sequence(1, n)`` in bigint (A07 array fold, F06 range and
lambda map). 20! is the largest factorial a bigint holds, so the function is NULL
outside 0..20, as Spark's built-in ``factorial`` is.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FACTORIAL_BODY = (
    "CASE WHEN n BETWEEN 0 AND 20 THEN "
    "aggregate(filter(sequence(1L, greatest(n, 1L)), x -> x <= n), 1L, (acc, x) -> acc * x) END"
)


def register_factorial(spark: SparkSession, name: str = "factorial_u64", temporary: bool = True) -> str:
    """Create or replace the function; running it again is harmless (idempotent, like the
    reference's init script)."""
    kind = "TEMPORARY FUNCTION" if temporary else "FUNCTION"
    spark.sql(f"CREATE OR REPLACE {kind} {name}(n BIGINT) RETURNS BIGINT RETURN {FACTORIAL_BODY}")
    return name
