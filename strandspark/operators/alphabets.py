"""Alphabets whose characters are numbered in order, and counting sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def characters(df: DataFrame, text: str) -> DataFrame:
    """(ch, n): every character of all texts with its number of occurrences; they are combined before the shuffle."""
    return df.select(F.explode(F.split(F.col(text), "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


def alphabet(df: DataFrame, text: str, terminator: bool = False) -> DataFrame:
    """(ch, comp): distinct characters numbered from 0 in the order of code points; with ``terminator``, U+0000 is one of them. Its
    length is the alphabet's size. One window over distinct characters, of which there are at most 1,114,112."""
    chars = characters(df, text).select("ch")
    if terminator:
        chars = chars.union(df.sparkSession.sql("SELECT char(0) AS ch")).distinct()
    return chars.withColumn("comp", F.row_number().over(Window.orderBy("ch")) - 1)


def char_to_comp(alphabet_: DataFrame) -> Column:
    """A map literal from character to number, for expressions; the alphabet's size is bounded, so it is collected."""
    pairs = [(r["ch"], r["comp"]) for r in alphabet_.collect()]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def counting_sort(df: DataFrame, key: str, order: list[str], name: str = "position", by: list[str] | None = None) -> DataFrame:
    """Positions from 1 of a stable sort by a key of few values: a key's rows start behind the counts of all lesser keys, and
    are numbered among themselves in input order. Keys' counts are combined before the shuffle; a key's rows are spread
    over ranges, so a hot key is no single task's."""
    from strandspark.operators import positions

    by = by or []
    counts = df.groupBy(*by, key).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inside = positions.numbered(df, order, "_in", [*by, key])
    return inside.join(starts, [*by, key]).withColumn(name, F.col("_start") + F.col("_in")).drop("_start", "_in")


def key_counts(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """(key, n) for every integer from ``low`` to ``high``, zero where there is none."""
    keys = df.sparkSession.range(low, high + 1).select(F.col("id").alias(key))
    counts = df.groupBy(F.col(key).cast("bigint").alias(key)).agg(F.count("*").alias("n"))
    return keys.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
