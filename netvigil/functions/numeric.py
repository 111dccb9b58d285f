"""Numeric coercion and safe arithmetic as Column expressions.

All functions are built from JVM-side SQL functions so they stay inside
whole-stage codegen and are safe under ANSI mode (no raising casts).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text accepted as a number: optional sign, digits with optional fraction
# (or a bare fraction), optional exponent, surrounding whitespace.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INF_PATTERN = r"(?i)^\s*[+-]?inf(inity)?\s*$"

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                  T.DoubleType, T.DecimalType)


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_NUMBER_CHARS = "0123456789.+-e"
_INF_WORDS = ["inf", "+inf", "infinity", "+infinity"]
_NEG_INF_WORDS = ["-inf", "-infinity"]


def to_numeric_text(c) -> Column:
    """Coerce text to double: bad text -> NULL, 'inf' words -> +/-Infinity.

    Accepts what ``NUMBER_PATTERN`` describes: the trimmed text may only
    use digits, '.', signs and 'e' (checked with ``translate``, no regex
    per row) and must then parse as a double.  Unlike a plain cast it
    rejects Java-only literals such as ``1d``, ``1.0f`` or hex floats, and
    treats ``nan`` as missing.
    """
    s = _as_col(c).cast("string")
    trimmed = F.btrim(s, F.lit(" \t\n\r\f\v"))
    low = F.lower(trimmed)
    plain = (trimmed != "") & (F.translate(low, _NUMBER_CHARS, "") == "")
    return (F.when(plain, trimmed.try_cast("double"))
            .when(low.isin(*_INF_WORDS), F.lit(float("inf")))
            .when(low.isin(*_NEG_INF_WORDS), F.lit(float("-inf"))))


def to_numeric(df_or_type, c=None) -> Column:
    """``to_numeric`` for a column of any type.

    ``to_numeric(df, "x")`` looks at the column type: numbers are cast to
    double (NaN becomes NULL), booleans to 0/1, everything else goes
    through :func:`to_numeric_text`.
    """
    if c is None:
        return to_numeric_text(df_or_type)
    dtype = df_or_type.schema[c].dataType if not isinstance(df_or_type, T.DataType) else df_or_type
    col = F.col(f"`{c}`") if isinstance(c, str) else c
    if isinstance(dtype, _NUMERIC_TYPES):
        d = col.cast("double")
        return F.when(~F.isnan(d), d)
    if isinstance(dtype, T.BooleanType):
        return col.cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        # epoch nanoseconds, as pandas converts datetimes
        return F.unix_micros(col.cast("timestamp")).cast("double") * 1000.0
    return to_numeric_text(col)


def finite_or_null(c) -> Column:
    """NaN and +/-Infinity -> NULL (for JSON-safe output and N2)."""
    x = _as_col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def zero_fill(c) -> Column:
    """+/-inf and NaN -> NULL -> 0."""
    return F.coalesce(finite_or_null(c), F.lit(0.0))


def safe_ratio(a, b) -> Column:
    """a / b, or 0.0 when b is 0 or NULL."""
    a, b = _as_col(a), _as_col(b)
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def round_half_even(c, digits: int) -> Column:
    """Rounding as numpy does it (banker's rounding)."""
    return F.bround(_as_col(c), digits)


def is_integral(c) -> Column:
    x = _as_col(c)
    return x == F.floor(x)
