"""Packed integer vectors as arrays of bigint words with a fixed number of bits an element, and as plain arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _left(x: Column, n) -> Column:
    return F.call_function("shiftleft", x, n if isinstance(n, Column) else F.lit(n))


def words_needed(size: Column | int, bits: int) -> Column:
    """Words of 64 bits that hold ``size`` elements of ``bits`` bits; an element does not span words."""
    return F.ceil((size if isinstance(size, Column) else F.lit(size)) / (64 // bits)).cast("bigint")


def bytes_needed(size: Column | int, bits: int) -> Column:
    return words_needed(size, bits) * 8


def pack(a: Column | str, bits: int) -> Column:
    """Elements (non-negative, below 2^bits) as words, the first element in the low bits."""
    a, per = _c(a), 64 // bits
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1, F.lit(per)))
    word = lambda s: F.aggregate(F.transform(F.slice(a, s + 1, F.lit(per)), lambda x, i: _left(x.cast("bigint"), i * bits)), F.lit(0).cast("bigint"), lambda w, x: w.bitwiseOR(x))
    return F.coalesce(F.transform(starts, word), F.expr("cast(array() as array<bigint>)"))


def load(words: Column | str, place: Column | int, bits: int) -> Column:
    """The element at a place from 0; null beyond the words."""
    place, per = place if isinstance(place, Column) else F.lit(place), 64 // bits
    word = F.get(_c(words), F.floor(place / per).cast("int"))
    mask = F.lit(-1 if bits == 64 else (1 << bits) - 1).cast("bigint")
    return F.call_function("shiftrightunsigned", word, ((place % per) * bits).cast("int")).bitwiseAND(mask)


def unpack(words: Column | str, size: Column | int, bits: int) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: load(words, i, bits))).otherwise(F.expr("cast(array() as array<bigint>)"))


def or_(a: Column | str, b: Column | str) -> Column:
    """Word by word; vectors of different lengths give null."""
    return F.when(F.size(_c(a)) == F.size(_c(b)), F.zip_with(_c(a), _c(b), lambda x, y: x.bitwiseOR(y)))


def and_(a: Column | str, b: Column | str) -> Column:
    return F.when(F.size(_c(a)) == F.size(_c(b)), F.zip_with(_c(a), _c(b), lambda x, y: x.bitwiseAND(y)))


def push_back(a: Column | str, value, times: Column | int = 1) -> Column:
    return F.concat(_c(a), F.array_repeat(value if isinstance(value, Column) else F.lit(value), times))


def reverse(a: Column | str) -> Column:
    return F.reverse(_c(a))


def resize(a: Column | str, size: int, value=0) -> Column:
    """The first ``size`` elements, filled up with ``value``."""
    a = _c(a)
    return F.concat(F.slice(a, 1, size), F.array_repeat(F.lit(value), F.greatest(F.lit(size) - F.size(a), F.lit(0))))


def equal(a: Column | str, b: Column | str) -> Column:
    """Same length and elements; nulls are equal."""
    return F.coalesce(_c(a).eqNullSafe(_c(b)), F.lit(False))


def less(a: Column | str, b: Column | str) -> Column:
    """Lexicographic order."""
    return _c(a) < _c(b)
