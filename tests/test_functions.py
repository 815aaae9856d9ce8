import datetime as dt

from pyspark.sql import functions as F

from quayside.functions.scalar import exact_decimal, iso_text, millis_to_ts, ts_to_millis, year_month
from quayside.functions.sql_udf import register_factorial
from quayside.functions.text import parse_list, quote_join, replace_first, replace_within, split_clean


def one(spark, col, data, ddl):
    return [r[0] for r in spark.createDataFrame(data, ddl).select(col).collect()]


def test_iso_text_like_python(spark):
    ts = [dt.datetime(2024, 1, 1, 1, 2, 3), dt.datetime(2024, 1, 1, 1, 2, 3, 4500)]
    got = one(spark, iso_text(F.col("t")), [(t,) for t in ts], "t timestamp_ntz")
    assert got == [t.isoformat() for t in ts]


def test_millis_round_trip_and_month(spark):
    t = dt.datetime(2024, 3, 5, 6, 7, 8, 123456)
    got = spark.createDataFrame([(t,)], "t timestamp_ntz").select(
        ts_to_millis("t").alias("ms"), millis_to_ts(ts_to_millis("t")).alias("back"), year_month("t").alias("ym")).first()
    assert got.ms == 1709618828123 and got.back == t.replace(microsecond=123000) and got.ym == 202403


def test_exact_decimal_rejects_loss(spark):
    got = one(spark, exact_decimal(F.col("s")), [("1.5",), ("0.0000000000000000001",), ("x",), ("",), ("123456789012345678901",)],
              "s string")
    assert [str(v) if v is not None else None for v in got] == ["1.500000000000000000", None, None, None, None]


def test_factorial_udf(spark):
    fn = register_factorial(spark, "fact_test")
    got = spark.sql(f"SELECT {fn}(n) FROM VALUES (-1), (0), (1), (5), (20), (21) AS t(n)").collect()
    assert [r[0] for r in got] == [None, 1, 1, 120, 2432902008176640000, None]


def test_split_clean_and_quote_join(spark):
    got = spark.createDataFrame([(" BTC/ ,eth ,, 'X' ",)], "s string").select(
        split_clean(F.col("s")).alias("a"), quote_join(split_clean(F.col("s"))).alias("q")).first()
    assert got.a == ["btc", "eth", "", "'x'"]
    assert got.q == "'btc', 'eth', '', '''x'''"
    assert parse_list(" a, b ,,c ") == ["a", "b", "c"]


def test_replace_first_and_within(spark):
    df = spark.createDataFrame([("<P>a</p><p>b</p> href=\"x.example.com/example\" mid example href=\"y\"",)], "s string")
    r = df.select(replace_first(F.col("s"), "<p>", "<p id=1>").alias("f"),
                  replace_within(F.col("s"), r'href="[^"]*"', "example", "E").alias("w")).first()
    assert r.f.startswith("<p id=1>a</p><p>b</p>")
    assert r.w.endswith('href="x.E.com/E" mid example href="y"')


def test_replace_first_with_alternatives_and_back_references(spark):
    from quayside.functions.text import replace_first
    from pyspark.sql import functions as F
    r = spark.range(1).select(replace_first(F.lit("xbxb"), "a|b", "Z").alias("a"),
                              replace_first(F.lit("abccd"), r"(.)\1", "<$1>").alias("b")).first()
    assert (r.a, r.b) == ("xZxb", "ab<c>d")


def test_exact_product_against_python_decimals(spark):
    import random
    from decimal import Decimal, getcontext

    from quayside.functions.scalar import exact_difference, exact_product
    getcontext().prec = 90
    rnd = random.Random(3)
    pairs = []
    for _ in range(400):
        a, b = (Decimal(rnd.randrange(10 ** rnd.randrange(1, 19))).scaleb(-rnd.randrange(0, 13)) for _ in range(2))
        pairs.append((a, b))
    pairs += [(Decimal("0.000000001234"), Decimal("1000000000000")), (Decimal("1e-18"), Decimal("1e-18")), (None, Decimal(1))]
    df = spark.createDataFrame(pairs, "a decimal(38,18), b decimal(38,18)")
    found = 0
    for r in df.select("a", "b", exact_product("a", "b").alias("p"), exact_difference("a", "b").alias("d")).collect():
        if r.a is None:
            assert r.p is None and r.d is None
            continue
        true = r.a * r.b
        if r.p is not None:
            found += 1
            assert r.p == true
        elif true.normalize().as_tuple().exponent >= -18:     # NULL only where factors need too many digits
            assert len(r.a.normalize().as_tuple().digits) + len(r.b.normalize().as_tuple().digits) > 18
        assert r.d == r.a - r.b
    assert found > 100 and found < 402
