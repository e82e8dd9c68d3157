"""Parsing and text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_integer(c: Column) -> Column:
    """Null unless the whole text is an integer."""
    return c.try_cast("bigint")


def parse_boolean(c: Column, strict: bool = True) -> Column:
    """T or Y is true, F or N false; anything else is an error, or null if not ``strict``."""
    other = F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean") if strict else F.lit(None).cast("boolean")
    return F.when(c.isin("T", "Y"), True).when(c.isin("F", "N"), False).when(c.isNull(), F.lit(None).cast("boolean")).otherwise(other)


def parse_command_arguments(c: Column) -> Column:
    """Arguments separated by spaces; double quotes group, a doubled quote inside them is a quote; otherwise an error, with
    the place (from 1) up to which the text is a list of arguments."""
    pattern = r'(?:"(?:[^"]|"")*"|[^\s"]+)'
    ok = c.rlike(rf"^\s*(?:{pattern}(?:\s+{pattern})*)?\s*$")
    good = (F.length(F.regexp_extract(c, rf"^\s*(?:{pattern}(?:\s+{pattern})*(?=\s|$))?\s*", 0)) + 1).cast("string")
    args = F.transform(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), lambda a: F.when(a.startswith('"'), F.replace(F.substr(a, F.lit(2), F.length(a) - 2), F.lit('""'), F.lit('"'))).otherwise(a))
    return F.when(ok, args).otherwise(F.raise_error(F.concat(F.lit("not a list of arguments from "), good, F.lit(": "), c)).cast("array<string>"))


def hex_bytes(c: Column) -> Column:
    """Upper-case hexadecimal digits, two a byte; null otherwise."""
    return F.when(c.rlike("^(?:[0-9A-F]{2})*$"), F.unhex(c))


def only_printable(c: Column) -> Column:
    return c.rlike(r"^[\x20-\x7E]*$")


def cigar_operations(c: Column) -> Column:
    """CIGAR text as array of (op, len); ``*`` is empty, malformed text null."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    parsed = F.transform(runs, lambda r: F.struct(F.substr(r, F.length(r), F.lit(1)).alias("op"), F.substr(r, F.lit(1), F.length(r) - 1).cast("int").alias("len")))
    empty = F.expr("cast(array() as array<struct<op:string,len:int>>)")
    return F.when(c == "*", empty).when(c.rlike(r"^(\d+[MIDNSHP=X])+$"), parsed)


def cigar_text(ops: Column) -> Column:
    return F.when(F.size(ops) == 0, "*").otherwise(F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), ""))
