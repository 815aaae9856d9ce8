"""quayside: market-data, event and inventory analytics on Spark.

Modules: ``sources`` (readers), ``operators`` (decoders, write rules, aggregates,
quality, telemetry), ``functions`` (column expressions, SQL function), ``streaming``
(Structured Streaming jobs), ``plans`` (the driver query catalogue, its stand-in inputs
and DuckDB oracles). ``session`` holds session settings and the shared scratch space.
"""

__version__ = "0.1.0"
