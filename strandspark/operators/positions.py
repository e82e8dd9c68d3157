"""Positions and neighbours in one order over a whole table, without bringing the table, or a hot group, to one task.

Rows are dealt to ranges of the order. Each range is numbered for itself, and a table with a row per range (and group) says how
many rows, or which value, the ranges before it hold. The ranges are checkpointed first: their bounds come from a sample, so a task
that ran again could otherwise move rows between them. The order has to be total for the positions to be the same on every run.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANGE = "_range"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the folder of ``spark.checkpoint.dir``. Where that is unset, as in tests, a local session sets a folder of its
    own; a cluster's executors would not reach such a folder, so there it is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandspark-"))
    return df.checkpoint()


def _ranged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *order).withColumn(_RANGE, F.spark_partition_id()))


def _with_summary(ranged: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """Join a table keyed by (range, group) to its rows. Without groups it has a row per shuffle partition, and is broadcast."""
    here = summary.select(*[F.col(b).alias(f"_of_{b}") for b in by], F.col(_RANGE).alias("_of_range"), "_carried")
    match = F.col(_RANGE) == F.col("_of_range")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_of_{b}"))
    return ranged.join(here if by else F.broadcast(here), match).drop("_of_range", *[f"_of_{b}" for b in by])


def numbered(df: DataFrame, order: list[Column | str], name: str, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Add the position of each row, from 1, in the whole table or in its group. A group may hold any share of the rows."""
    by, ranged = list(by), _ranged(df, order)
    earlier = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*by, _RANGE).agg(F.count("*").alias("_n"))
    summary = counts.withColumn("_carried", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = ranged.withColumn("_inside", F.row_number().over(Window.partitionBy(_RANGE, *by).orderBy(*order)))
    out = _with_summary(inside, summary, by).withColumn(name, F.col("_inside") + F.col("_carried"))
    return out.drop("_inside", "_carried", _RANGE)


def with_previous(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the value of the row before in the group, as ``lag`` does, for groups too large for a task."""
    ranged = _ranged(df, [*by, *order])
    boxed = F.struct(F.col(value).alias("v"))
    ends = ranged.groupBy(*by, _RANGE).agg(F.max_by(boxed, F.struct(*order)).alias("_last"))
    summary = ends.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*by).orderBy(_RANGE))).drop("_last")
    inside = ranged.withColumn("_box", F.lag(boxed).over(Window.partitionBy(_RANGE, *by).orderBy(*order)))
    out = _with_summary(inside, summary, by).withColumn(name, F.coalesce("_box", "_carried")["v"])
    return out.drop("_box", "_carried", _RANGE)


def running(df: DataFrame, by: list[str], order: list[Column | str], value: str, name: str, kind: str = "sum", before: bool = False) -> DataFrame:
    """Add the sum or maximum (``kind``) of a value over the rows of the group up to each row, that row included or, with ``before``,
    not; null where there is none. For groups too large for a task."""
    aggregate = {"sum": F.sum, "max": F.max}[kind]
    ranged = _ranged(df, [*by, *order])
    parts = ranged.groupBy(*by, _RANGE).agg(aggregate(value).alias("_part"))
    earlier = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    summary = parts.withColumn("_carried", aggregate("_part").over(earlier)).drop("_part")
    w = Window.partitionBy(_RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = _with_summary(ranged.withColumn("_inside", aggregate(value).over(w)), summary, by)
    both = F.greatest("_inside", "_carried") if kind == "max" else F.coalesce(F.col("_inside") + F.col("_carried"), F.col("_inside"), F.col("_carried"))
    return out.withColumn(name, both).drop("_inside", "_carried", _RANGE)


def running_sum(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """Add the sum of a value over the whole table up to and with each row."""
    return running(df, [], order, value, name)
