"""Set operators and counts over (group, element) tables, and joins by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Outer merge of two sets of keys: each key with left, right or both."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def symmetric_difference_size(left: Column, right: Column) -> Column:
    return F.size(F.array_except(left, right)) + F.size(F.array_except(right, left))


def intersection_size(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def nonempty_intersection(left: Column, right: Column) -> Column:
    """Whether a value that is not null is in both."""
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def multiset_intersection_size(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Duplicates pair one to one."""
    a, b = left.groupBy(key).agg(F.count("*").alias("_a")), right.groupBy(key).agg(F.count("*").alias("_b"))
    return a.join(b, key).agg(F.coalesce(F.sum(F.least("_a", "_b")), F.lit(0)).alias("n"))


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def union(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).union(right.select(*keys)).distinct()


def mismatched_metadata(meta: DataFrame) -> DataFrame:
    """Entries (kind, id, file, number, type) whose number or type differs from that of another file. All files' values of a
    key are compared at once by a grouped minimum and maximum, not by a self-join."""
    seen = F.struct("number", "type")
    per = meta.groupBy("kind", "id").agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"), F.countDistinct("file").alias("files"))
    return per.where("lo <> hi").select("kind", "id", "files")


def matches_that_end(matches: DataFrame, at: str, pair: list[str]) -> DataFrame:
    """Matches (at, pair, more columns) that are there at a place and not at the next one, by an equi-join."""
    after = matches.select((F.col(at) - 1).alias(at), *pair).distinct()
    return matches.join(after, [at, *pair], "left_anti")
