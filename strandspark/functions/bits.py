"""Bit functions of non-negative 64-bit integers, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_bits_set(x: Column | str) -> Column:
    return F.bit_count(_c(x))


def trailing_zeros(x: Column | str) -> Column:
    """1-based position of the lowest set bit; 0 for zero."""
    return F.instr(F.reverse(F.bin(_c(x))), "1")


def leading_zeros(x: Column | str, width: int = 64) -> Column:
    return F.when(_c(x) == 0, width).otherwise(F.lit(width) - F.length(F.bin(_c(x))))


def highest_bit_set(x: Column | str) -> Column:
    """1-based; 0 for zero."""
    return F.when(_c(x) == 0, 0).otherwise(F.length(F.bin(_c(x))))


def is_power_of_2(x: Column | str) -> Column:
    return F.bit_count(_c(x)) == 1


def gte_power_of_2(x: Column | str, strict: bool = False) -> Column:
    """The least power of two that is not below x, 1 for 0; on overflow 0, or an error if ``strict``."""
    x = _c(x)
    over = F.raise_error(F.lit("no power of two fits")).cast("bigint") if strict else F.lit(0).cast("bigint")
    up = F.expr("shiftleft(1L, 0)")
    power = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(x - 1)))
    return F.when(x <= 1, up).when(x > (1 << 62), over).otherwise(power)


def reverse_bits(x: Column | str, group: int = 1, width: int = 64) -> Column:
    """The groups of ``group`` bits in reverse order, as a string of ``width`` binary digits (Spark has no unsigned)."""
    digits = F.lpad(F.bin(_c(x)), width, "0")
    if group == 1:
        return F.reverse(digits)
    parts = F.transform(F.sequence(F.lit(width // group - 1), F.lit(0), F.lit(-1)), lambda i: F.substr(digits, i * group + 1, F.lit(group)))
    return F.array_join(parts, "")


def from_bits(digits: Column) -> Column:
    """Binary digits as a signed 64-bit integer."""
    return F.conv(digits, 2, -10).cast("bigint")


def fill_bit_pattern(x: Column | str, bits: int, width: int = 64) -> Column:
    """The low ``bits`` bits repeated over the word, as binary digits."""
    return F.repeat(F.lpad(F.bin(_c(x).bitwiseAND((1 << bits) - 1)), bits, "0"), width // bits)
