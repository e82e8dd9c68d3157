"""Assertions and comparisons over columns."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def checked(value: Column, holds: Column, message: str) -> Column:
    """``value``, or an error where ``holds`` is not true."""
    return F.when(F.coalesce(holds, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def compared(a: Column, op: str, b: Column, debug: bool = True) -> Column:
    """``a``, or an error that names both values where the comparison does not hold; unchecked if not ``debug``."""
    if not debug:
        return a
    text = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    return F.when(F.coalesce(_COMPARE[op](a, b), F.lit(False)), a).otherwise(F.raise_error(F.concat(F.lit("expected "), text(a), F.lit(f" {op} "), text(b))))


def _wide(c: Column, unsigned: bool) -> Column:
    """The number that a 64-bit word stands for, as a decimal that holds both kinds."""
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, d + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)") if unsigned else d


def mixed(a: Column, op: str, b: Column, a_unsigned: bool = False, b_unsigned: bool = True) -> Column:
    """Comparison of signed and unsigned 64-bit words by the numbers they stand for."""
    return _COMPARE[op](_wide(a, a_unsigned), _wide(b, b_unsigned))


def log_time(message: Column | str) -> Column:
    """The message behind the time of day, [HH:MM:SS]."""
    return F.concat(F.date_format(F.current_timestamp(), "'['HH:mm:ss'] '"), F.col(message) if isinstance(message, str) else message)
