"""Request telemetry over recorded responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import whole_number_text

# Fixed values from the exchange client: request weights per endpoint, the per-minute
# budget, and the used-weight alert levels.
ENDPOINT_WEIGHT = {"exchangeInfo": 20, "aggTrades": 2, "depth": 2, "ticker24hr": 2}
WEIGHT_BUDGET_PER_MINUTE = 5000
PAUSE_AT, WARN_AT = 5700, 4800


def disposition(status: Column, retry_after: Column) -> Column:
    """What the client does with a response, tested in the client's order:
    200 ok, 418 ban, 429 retry (after the header's seconds if a whole number), 400 skip,
    >= 500 retry, anything else error."""
    return (F.when(status == 200, "ok")
            .when(status == 418, "ban")
            .when((status == 429) & whole_number_text(retry_after), "retry_after_header")
            .when(status == 429, "retry_backoff")
            .when(status == 400, "skip")
            .when(status >= 500, "retry_backoff")
            .otherwise("error"))


def weight_alert(used_weight: Column) -> Column:
    """Alert level from the used-weight header; empty or non-numeric -> 'none'."""
    w = F.when(whole_number_text(used_weight), used_weight.try_cast("bigint"))
    return (F.when(w.isNull(), "none").when(w >= PAUSE_AT, "pause").when(w >= WARN_AT, "warn").otherwise("ok"))


def request_weight(endpoint: Column) -> Column:
    expr = F.lit(None).cast("int")
    for ep, wt in ENDPOINT_WEIGHT.items():
        expr = F.when(endpoint == ep, F.lit(wt)).otherwise(expr)
    return expr


def response_disposition(responses: DataFrame) -> DataFrame:
    return responses.groupBy("endpoint", "status", disposition(F.col("status"), F.col("retry_after"))
                             .alias("disposition")).agg(F.count(F.lit(1)).alias("responses"))


def weight_budget(responses: DataFrame) -> DataFrame:
    """Weight spent per minute and endpoint against the per-minute budget, plus the
    minute's total over all endpoints (the budget is shared by the whole client) and
    whether that total exceeds it. The total is a window over the aggregated rows (a
    handful of endpoints per minute), not over the responses."""
    minute = F.window("fetched_at", "1 minute").start
    g = responses.groupBy(minute.alias("minute_start"), "endpoint").agg(
        F.sum(request_weight(F.col("endpoint"))).cast("bigint").alias("weight_used"),
        F.count(F.lit(1)).alias("requests"))
    total = F.sum("weight_used").over(Window.partitionBy("minute_start")).cast("bigint")
    return (g.withColumn("budget_pct",
                         F.round(F.col("weight_used").cast("double") * 100.0 / WEIGHT_BUDGET_PER_MINUTE, 3))
             .withColumn("minute_weight", total)
             .withColumn("over_budget", F.col("minute_weight") > WEIGHT_BUDGET_PER_MINUTE))
