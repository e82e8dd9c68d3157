"""Operations on fixed lists of values, as array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Unary, Binary = Callable[[Column], Column], Callable[[Column, Column], Column]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fmap(a: Column | str, f: Unary) -> Column:
    return F.transform(_c(a), f)


def pairwise_apply(a: Column | str, b: Column | str, f: Binary) -> Column:
    """``f`` of the elements at equal places, up to the shorter list's end."""
    a, b = _c(a), _c(b)
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f)


def keep(a: Column | str, f: Unary) -> Column:
    """The elements that satisfy ``f``; null is no."""
    return F.filter(_c(a), lambda x: F.coalesce(f(x), F.lit(False)))


def erase(a: Column | str, f: Unary) -> Column:
    """The elements that do not satisfy ``f``; null is no."""
    return F.filter(_c(a), lambda x: ~F.coalesce(f(x), F.lit(False)))


def find(a: Column | str, value) -> Column:
    """Place of the first such element from 0; -1 if there is none."""
    return (F.coalesce(F.array_position(_c(a), value), F.lit(0)) - 1).cast("int")


def foldl(a: Column | str, start: Column, f: Binary) -> Column:
    return F.aggregate(_c(a), start, f)


def unique(a: Column | str) -> Column:
    """The elements in the order in which they first appear."""
    return F.array_distinct(_c(a))


def slice_(a: Column | str, begin: int, end: int) -> Column:
    """Elements from ``begin`` (from 0) to before ``end``."""
    return F.slice(_c(a), begin + 1, end - begin)


def head(a: Column | str) -> Column:
    return F.get(_c(a), F.lit(0))


def last(a: Column | str) -> Column:
    return F.get(_c(a), F.size(_c(a)) - 1)


def cat(*arrays: Column | str) -> Column:
    return F.concat(*[_c(a) for a in arrays])


def cross(a: Column | str, b: Column | str, f: Binary) -> Column:
    """``f`` of every pair, in the order of the first list, then of the second."""
    return F.flatten(F.transform(_c(a), lambda x: F.transform(_c(b), lambda y: f(x, y))))


def element_or(a: Column | str, place: int, default) -> Column:
    """The element at a place from 0, or a default where the list is shorter or the element null."""
    return F.coalesce(F.get(_c(a), F.lit(place)), F.lit(default))


def group_by(a: Column | str, key: Unary) -> Column:
    """Array of (key, elements), keys in the order in which they first appear, elements in theirs."""
    a = _c(a)
    return F.transform(F.array_distinct(F.transform(a, key)), lambda k: F.struct(k.alias("key"), F.filter(a, lambda x: key(x).eqNullSafe(k)).alias("elements")))
