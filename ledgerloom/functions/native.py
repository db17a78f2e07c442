"""Decoders of log values as Spark column expressions: binary in, typed columns out, no Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import DIGIT_BYTES


def byte(data: Column, i: int) -> Column:
    """The i-th byte (from 0) as a bigint."""
    return F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("bigint")


def uint_be(data: Column, at: int, size: int) -> Column:
    """An unsigned big-endian number of up to 7 bytes."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("bigint")


def uint_le(data: Column, at: int, size: int) -> Column:
    """An unsigned little-endian number: bigint, or decimal(20,0) for 8 bytes."""
    digits = F.concat(*[F.hex(F.substring(data, at + i + 1, 1)) for i in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("bigint" if size < 8 else "decimal(20,0)")


def int_le(data: Column, at: int, size: int) -> Column:
    """A signed little-endian number of 1, 2, 3, 4 or 8 bytes."""
    value = uint_le(data, at, size)
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)" if size == 8 else "bigint")
    return F.when(value >= number(2 ** (8 * size - 1)), value - number(2 ** (8 * size))).otherwise(value).cast("bigint")


def date_value(data: Column) -> Column:
    """Three bytes; zero and impossible dates are null."""
    x = uint_le(data, 0, 3)
    year, month, day = F.shiftright(x, 9), F.shiftright(x, 5).bitwiseAND(F.lit(15)), x.bitwiseAND(F.lit(31))
    return F.to_date(F.when((month > 0) & (day > 0), F.format_string("%04d-%02d-%02d", year, month, day)))


def datetime_value(data: Column, digits: int = 0) -> Column:
    """Five bytes, and those of a fraction of ``digits`` digits; zero is null."""
    x = uint_be(data, 0, 5) - F.lit(1 << 39)
    date, time = F.shiftright(x, 17), x.bitwiseAND(F.lit((1 << 17) - 1))
    months, day = F.shiftright(date, 5), date.bitwiseAND(F.lit(31))
    month = F.pmod(months, F.lit(13))
    parts = [(months / 13).cast("int"), month.cast("int"), day.cast("int"), F.shiftright(time, 12).cast("int"), F.shiftright(time, 6).bitwiseAND(F.lit(63)).cast("int"), time.bitwiseAND(F.lit(63)).cast("decimal(8,6)")]
    if size := (digits + 1) // 2:
        parts[-1] += (uint_be(data, 5, size) * 10 ** (6 - 2 * size) / F.lit(10**6)).cast("decimal(7,6)")
    return F.when((month > 0) & (day > 0), F.make_timestamp_ntz(*parts))


def timestamp_value(data: Column) -> Column:
    """Four bytes of big-endian seconds; zero is null."""
    seconds = uint_be(data, 0, 4)
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def time_text(data: Column) -> Column:
    """The older three-byte TIME as text, with a minus where it is negative."""
    signed = int_le(data, 0, 3)
    x = F.abs(signed)
    part = lambda div: F.pmod(F.floor(x / div), F.lit(100))
    return F.concat(F.when(signed < 0, F.lit("-")).otherwise(F.lit("")), F.format_string("%02d:%02d:%02d", F.floor(x / 10000), part(100), part(1)))


def decimal_value(data: Column, precision: int, scale: int) -> Column:
    """A packed decimal of up to 38 digits: its groups' digits are put together as text and cast once."""
    negative = byte(data, 0) < 128

    def octet(i: int) -> Column:
        b = byte(data, i)
        b = b.bitwiseXOR(F.lit(128)) if i == 0 else b
        return F.when(negative, F.lit(255) - b).otherwise(b)

    whole, part = precision - scale, scale
    at, texts = 0, []
    for digits in [d for d in [whole % 9, *[9] * (whole // 9), -1, *[9] * (part // 9), part % 9] if d]:
        if digits < 0:
            texts.append(F.lit("."))
            continue
        size = DIGIT_BYTES[digits]
        value = octet(at)
        for i in range(1, size):
            value = value * 256 + octet(at + i)
        texts.append(F.lpad(value.cast("string"), digits, "0"))
        at += size
    text = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), F.lit("0"), *texts, F.lit("0") if not scale else F.lit(""))
    return text.cast(f"decimal({precision},{scale})")


def crc_ok(event: Column, length: Column) -> Column:
    """Whether an event's last four bytes are the CRC-32 of those before."""
    tail = F.concat(*[F.hex(event.substr(length - F.lit(i), F.lit(1))) for i in range(4)])
    return F.crc32(event.substr(F.lit(1), length - 4)) == F.conv(tail, 16, 10).cast("bigint")


def uuid_text(data: Column) -> Column:
    """Sixteen bytes as the usual 36 characters."""
    h = F.lower(F.hex(data))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def version_product(text: Column) -> Column:
    """A server version as one number: 8.0.23 is (8 * 256 + 0) * 256 + 23."""
    part = lambda i: F.coalesce(F.regexp_extract(F.get(F.split(text, r"\."), F.lit(i)), r"^(\d+)", 1).try_cast("bigint"), F.lit(0))
    return (part(0) * 256 + part(1)) * 256 + part(2)


def epoch_of_text(text: Column) -> Column:
    """Seconds since 1970 of ``YYYY-M-D h:m:s`` in the session's zone."""
    return F.unix_timestamp(F.to_timestamp(text, "y-M-d H:m:s"))


# Decimal rounding, five ways. Shifts are exact products with powers of ten.


def truncated(x: Column, scale: int) -> Column:
    return F.when(x < 0, F.ceil(x, F.lit(scale))).otherwise(F.floor(x, F.lit(scale)))


ROUNDINGS = {
    "truncate": truncated,
    "half_even": lambda x, scale: F.bround(x, scale),
    "half_up": lambda x, scale: F.round(x, scale),
    "ceiling": lambda x, scale: F.ceil(x, F.lit(scale)),
    "floor": lambda x, scale: F.floor(x, F.lit(scale)),
}


def shifted(x: Column, places: int) -> Column:
    """x times ten to the power of ``places``, as a decimal."""
    power = F.lit(10 ** abs(places)).cast("decimal(20,0)")
    return x * power if places >= 0 else x / power
