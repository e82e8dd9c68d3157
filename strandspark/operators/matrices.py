"""Matrices as cells (row, col, val), and sparse lists as cells (idx, val). A cell that is not there is ``default``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.operators import positions


def row(m: DataFrame, at: int) -> DataFrame:
    return m.where(F.col("row") == at).select("col", "val")


def column(m: DataFrame, at: int) -> DataFrame:
    return m.where(F.col("col") == at).select("row", "val")


def part(m: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells of half-open ranges, numbered from 0."""
    inside = (F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1])
    return m.where(inside).select((F.col("row") - rows[0]).alias("row"), (F.col("col") - cols[0]).alias("col"), "val")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def apply(m: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return m.withColumn("val", f(F.col("val")))


def swap_rows(m: DataFrame, a: int, b: int) -> DataFrame:
    return m.withColumn("row", F.when(F.col("row") == a, F.lit(b)).when(F.col("row") == b, F.lit(a)).otherwise(F.col("row")))


def resize(m: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cells beyond the new size are gone; new cells hold the default."""
    return m.where((F.col("row") < rows) & (F.col("col") < cols))


def same(a: DataFrame, b: DataFrame, default=0) -> bool:
    """Equality of all cells, those that hold the default or are not there being equal."""
    a, b = (m.select("row", "col", "val").where(~F.col("val").eqNullSafe(F.lit(default))) for m in (a, b))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def fill_column(m: DataFrame, at: int, rows: int, pattern: list) -> DataFrame:
    """A column that is 0 so far gets a pattern, repeated down to ``rows``; other values there are an error."""
    spark = m.sparkSession
    taken = F.raise_error(F.lit("the column is not empty")).cast(m.schema["val"].dataType)
    kept = m.withColumn("val", F.when((F.col("col") == at) & (F.col("val") != 0), taken).otherwise(F.col("val"))).where(~((F.col("col") == at) & (F.col("val") == 0)))
    values = F.array(*[F.lit(p) for p in pattern])
    filled = spark.range(rows).select(F.col("id").cast(m.schema["row"].dataType).alias("row"), F.lit(at).cast(m.schema["col"].dataType).alias("col"), F.get(values, (F.col("id") % len(pattern)).cast("int")).cast(m.schema["val"].dataType).alias("val"))
    return kept.select("row", "col", "val").unionByName(filled)


# --- sparse lists ------------------------------------------------------------------------------------------------------


def push_back(cells: DataFrame, values: DataFrame, order: list[str], value: str = "val") -> DataFrame:
    """Values in order behind the last place of the list."""
    end = cells.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("_end"))
    numbered = positions.numbered(values, order, "_n")
    behind = numbered.crossJoin(F.broadcast(end))  # one row
    return cells.select("idx", "val").unionByName(behind.select((F.col("_end") + F.col("_n") - 1).alias("idx"), F.col(value).alias("val")))


def link(cells: DataFrame) -> DataFrame:
    """(idx, val, previous, next): the neighbouring places that are filled."""
    before = positions.with_previous(cells.select("idx", "val"), [], ["idx"], "idx", "previous")
    after = positions.with_previous(cells.select((-F.col("idx")).alias("_back"), "idx"), [], ["_back"], "idx", "next")
    return before.join(after.select("idx", "next"), "idx")


def erase(cells: DataFrame, places: DataFrame) -> DataFrame:
    return cells.join(places.select("idx").distinct(), "idx", "left_anti")


def find(cells: DataFrame, place: int) -> DataFrame:
    return cells.where(F.col("idx") == place)
