"""Scalar column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def millis_to_ts(c) -> Column:
    """epoch milliseconds -> UTC wall time (timestamp_ntz), independent of the session zone."""
    return F.timestamp_add("MILLISECOND", _c(c), F.expr(EPOCH_NTZ))


def ts_to_millis(c) -> Column:
    """Inverse of F01 for timestamp_ntz columns (floor to the millisecond)."""
    return F.timestamp_diff("MILLISECOND", F.expr(EPOCH_NTZ), _c(c))


def cut_to_millis(c) -> Column:
    """DateTime64(3): drop sub-millisecond digits."""
    return millis_to_ts(ts_to_millis(c))


def iso_text(c) -> Column:
    """Python ``datetime.isoformat()`` of a timestamp_ntz: the fraction is
    printed with 6 digits, and left out entirely when it is zero."""
    c = _c(c)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(c.isNull(), F.lit(None)).when(
        F.date_format(c, "SSSSSS") == "000000", whole
    ).otherwise(F.concat(whole, F.lit("."), F.date_format(c, "SSSSSS")))


def exact_decimal(text, precision: int = 38, scale: int = 18) -> Column:
    """exact decimal from text. NULL when the text is no number or does not
    fit ``decimal(precision, scale)`` without loss (callers quarantine NULLs).

    A cast rounds digits beyond the scale away, so the decimals written are counted: those
    of the mantissa without closing zeros, less the exponent. A short text without an exponent
    cannot have too many, and is not searched."""
    t = _c(text)
    plain = ~F.lower(t).contains("e")
    point = F.when(t.contains("."), F.length(F.rtrim(F.trim(F.substring_index(t, ".", -1)), F.lit("0")))).otherwise(0)
    mantissa = F.length(F.rtrim(F.regexp_extract(t, r"\.([0-9]*)", 1), F.lit("0")))
    exponent = F.coalesce(F.regexp_extract(t, r"[eE]([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))
    fits = (plain & ((F.length(t) <= scale + 1) | (point <= scale))) | (~plain & (mantissa - exponent <= scale))
    return F.when(fits, t.try_cast(f"decimal({precision},{scale})"))


def exact_product(a, b) -> Column:
    """``a * b`` of two ``decimal(38,18)`` as ``decimal(38,18)`` without loss, else NULL.

    The type of a plain product keeps 6 decimals only. A factor with s decimals in 18 digits
    times one with 18 - s decimals in 19 digits is exact in ``decimal(38,18)``; the first s
    that holds both factors is taken (8 first, the decimals of most prices)."""
    a, b = _c(a), _c(b)
    tries = []
    for s in sorted(range(19), key=lambda x: abs(x - 8)):
        x, y = a.try_cast(f"decimal(18,{s})"), b.try_cast(f"decimal(19,{18 - s})")
        tries.append(F.when((x == a) & (y == b), (x * y).cast("decimal(38,18)")))
    return F.coalesce(*tries)


def exact_difference(a, b) -> Column:
    """``a - b`` of two ``decimal(38,18)`` as ``decimal(38,18)``; exact below 1e19 each, where
    the plain difference rounds to 17 decimals (that is the result beyond)."""
    a, b = _c(a), _c(b)
    return F.coalesce(a.try_cast("decimal(37,18)") - b.try_cast("decimal(37,18)"),
                      (a - b).try_cast("decimal(38,18)"))


def year_month(c) -> Column:
    """``toYYYYMM``."""
    c = _c(c)
    return F.year(c) * 100 + F.month(c)


def utf8_prefix_bytes(c, n: int) -> Column:
    """first ``n`` bytes of the UTF-8 encoding (binary)."""
    return F.substring(F.encode(_c(c), "UTF-8"), 1, n)


def utf8_prefix_text(c, n: int) -> Column:
    """F08 for display: byte prefix decoded leniently (a cut character becomes U+FFFD)."""
    return F.make_valid_utf8(utf8_prefix_bytes(c, n).cast("string"))


def zero_if_null(c, zero) -> Column:
    """a missing or null JSON field reads as the type's zero value."""
    return F.coalesce(_c(c), F.lit(zero))


def non_empty(c) -> Column:
    """Required text present (NULL and '' treated alike)."""
    return F.coalesce(_c(c), F.lit("")) != ""


def whole_number_text(c) -> Column:
    """``strconv.Atoi`` acceptance: optional sign, then digits only (no blanks)."""
    return F.coalesce(_c(c).rlike(r"^[+-]?[0-9]+$"), F.lit(False))
