"""Exact decimal arithmetic as Spark column expressions, with the rules of the log's decimal type.

Quotients are cut, not rounded, at a given number of digits; remainders have the dividend's sign; conversions that don't fit, and
divisions by zero, are null. Everything stays decimal: no step goes through a double.
"""

from __future__ import annotations

import decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import decimal_size

#: The most digits that Spark's decimals have.
DIGITS = 38


def _power(n: int) -> Column:
    return F.lit(decimal.Decimal(10) ** n).cast(f"decimal({n + 1},0)")


def added(a: Column, b: Column) -> Column:
    return a + b


def subtracted(a: Column, b: Column) -> Column:
    return a - b


def multiplied(a: Column, b: Column) -> Column:
    return a * b


def divided(a: Column, b: Column, scale: int, of: int = 2) -> Column:
    """a / b cut at ``scale`` digits, for operands of up to ``of`` digits behind the point; null where b is 0."""
    whole = lambda x: F.abs(x * _power(of)).cast(f"decimal({DIGITS - scale - 1},0)")
    numerator = (whole(a) * _power(scale)).cast(f"decimal({DIGITS},0)")
    rest = numerator % whole(b)
    # What is left after the remainder is taken away divides exactly.
    quotient = ((numerator - rest) / whole(b)).cast(f"decimal({DIGITS - scale},0)")
    signed = F.when((a < 0) != (b < 0), -quotient).otherwise(quotient)
    return F.when(b != 0, (signed * F.lit(decimal.Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")).cast(f"decimal({DIGITS},{scale})"))


def remainder(a: Column, b: Column) -> Column:
    """Of the division to a whole number, with the sign of a; null where b is 0."""
    return F.when(b != 0, a % b)


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def to_long(x: Column, unsigned: bool = False) -> Column:
    """The whole part; null where it doesn't fit 64 bits. Unsigned ones are decimal(20,0)."""
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    low, high = (0, 2**64 - 1) if unsigned else (-(2**63), 2**63 - 1)
    limit = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    return F.when((whole >= limit(low)) & (whole <= limit(high)), whole.cast("decimal(20,0)" if unsigned else "bigint"))


def from_long(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def parts(x: Column) -> Column:
    """A struct of the whole part (quot) and of the billionths behind it (rem), both with the sign of x."""
    quot = to_long(x)
    rem = F.when(quot.isNotNull(), (x % F.lit(1).cast("decimal(1,0)")) * _power(9))
    return F.struct(quot.alias("quot"), F.when(rem < 0, F.ceil(rem)).otherwise(F.floor(rem)).cast("bigint").alias("rem"))


def from_text(text: Column, precision: int, scale: int) -> Column:
    """The number that a text begins with (sign, digits, point, exponent), rounded half up; null where there is none or it doesn't fit."""
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(number != "", number).try_cast(f"decimal({precision},{scale})")


def from_double(x: Column, precision: int, scale: int) -> Column:
    """By the shortest text that is the double."""
    return from_text(x.cast("string"), precision, scale)


def to_double(x: Column) -> Column:
    return x.cast("string").cast("double")


def largest(precision: int, scale: int) -> Column:
    """The largest number of a type."""
    return F.lit(decimal.Decimal("9" * precision).scaleb(-scale)).cast(f"decimal({precision},{scale})")


def integer_digits(x: Column) -> Column:
    """Digits before the point, without leading zeros."""
    return F.length(F.regexp_extract(F.abs(x).cast("decimal(38,18)").cast("string"), r"^0*(\d*)", 1))


def fraction_digits(x: Column) -> Column:
    """Digits behind the point, without zeros at the end."""
    return F.length(F.regexp_extract(x.cast("string"), r"\.(\d*?)0*$", 1))


def is_zero(x: Column) -> Column:
    return x == 0


def stored_bytes(precision: int, scale: int) -> int:
    """Bytes of a packed decimal."""
    return decimal_size(precision, scale)
