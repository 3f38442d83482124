"""Unsigned 64-bit values, hex text and wider literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"


def hex_to_u64(digits: Column, known: bool = False) -> Column:
    """Hex digits without prefix; NULL for text that is empty, not hex or over 64 bits. ``known``: a pattern has told that it is hex."""
    short = F.length(F.ltrim(digits, F.lit("0"))) <= 16
    fits = short if known else digits.rlike("^[0-9a-fA-F]+$") & short
    return F.when(fits, F.conv(F.when(fits, digits), 16, 10).cast(U64))


def binary_to_u64(digits: Column) -> Column:
    fits = digits.rlike("^[01]+$") & (F.length(digits) <= 64)
    return F.when(fits, F.conv(F.when(fits, digits), 2, 10).cast(U64))


def hex_text(value: Column) -> Column:
    """``0x`` and lower-case digits, the form used wherever addresses are shown."""
    half = F.lit(1 << 32).cast(U64)
    low = value.cast(U64) % half
    high = ((value.cast(U64) - low) / half).cast("long")
    digits = F.lower(F.hex(low.cast("long")))
    return F.concat(F.lit("0x"), F.when(high > 0, F.concat(F.lower(F.hex(high)), F.lpad(digits, 8, "0"))).otherwise(digits))


def narrow_value(raw: Column) -> Column:
    """Decimal or ``0x`` literal below 2^64 as a number, NULL otherwise."""
    dec = raw.rlike("^[0-9]{1,20}$")
    number = F.when(dec, F.when(dec, raw).cast("decimal(38,0)"))
    small = F.when(number < F.lit("18446744073709551616").cast("decimal(38,0)"), number.cast(U64))
    return F.coalesce(small, hex_to_u64(F.regexp_extract(raw, "^0x([0-9a-fA-F]+)$", 1)))


def wide_value(raw: Column) -> Column:
    """What :func:`narrow_value` cannot hold, kept as text."""
    return F.when(narrow_value(raw).isNull(), raw)
