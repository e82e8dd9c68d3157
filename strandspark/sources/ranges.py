"""Files of records read by ranges of bytes, many tasks a file, where only the records themselves tell where one starts.

Each range is searched for its first record, and walked to the first record beyond its end. A search may go wrong, so
each range's end has to be the next one's start, and the last one's the file's; where it is not, the file is read as one
range, from its start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandspark.operators import positions

RANGE_BYTES = 64 << 20


def open_file(uri: str):
    """A seekable binary file, on any file system that pyarrow opens."""
    from pyarrow import fs

    if uri.startswith("file:"):
        system, path = fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    elif "://" not in uri:
        system, path = fs.LocalFileSystem(), uri
    else:
        system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, size); contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))


def cut(listed: DataFrame, range_bytes: int, whole: str | None = None) -> DataFrame:
    """(file, size, lo, hi); files whose name ends as ``whole`` says are one range."""
    at = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))
    if whole:
        at = F.when(F.col("file").endswith(whole), F.array(F.lit(0).cast("bigint"))).otherwise(at)
        size = F.when(F.col("file").endswith(whole), F.col("size")).otherwise(F.least(F.col("lo") + range_bytes, F.col("size")))
    else:
        size = F.least(F.col("lo") + range_bytes, F.col("size"))
    return listed.select("file", "size", F.explode(at).alias("lo")).withColumn("hi", size)


def _spread(df: DataFrame) -> DataFrame:
    n = max(1, min(20_000, df.count()))
    return df.repartitionById(n, F.pmod(F.xxhash64("file", "lo"), F.lit(n)).cast("int"))


def indexed(ranges: DataFrame, walk: Callable[[str, int, int, int], tuple[str, str]]) -> DataFrame:
    """(file, size, lo, hi, start): ranges with the place of their first record. ``walk(file, size, lo, hi)`` gives the places of the first
    record of a range and of the first one beyond it, as text; the empty text if there is none."""

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, size, lo, hi in zip(b["file"], b["size"], b["lo"], b["hi"]):
                start, end = walk(file, int(size), int(lo), int(hi))
                yield pd.DataFrame({"file": [file], "size": [size], "lo": [lo], "hi": [hi], "start": [start], "end": [end]})

    found = positions.checkpointed(_spread(ranges).mapInPandas(walked, "file string, size bigint, lo bigint, hi bigint, start string, end string"))
    # a range in which no record starts passes the end of the one before on
    w = Window.partitionBy("file").orderBy("lo")
    reach = F.last(F.when(F.col("start") != "", F.col("end")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    linked = found.withColumn("_before", reach)
    wrong = linked.where("start <> '' AND _before IS NOT NULL AND _before <> start").select("file")
    # the last range in which a record starts has to end with the file
    ends = found.where("start <> ''").groupBy("file").agg(F.max_by("end", "lo").alias("_last"))
    wrong = wrong.union(ends.where("_last <> ''").select("file")).distinct()
    good = linked.join(wrong, "file", "left_anti").where("start <> ''").select("file", "size", "lo", "hi", "start")
    whole = linked.join(wrong, "file", "left_semi").where("lo = 0").select("file", "size", "lo", F.col("size").alias("hi"), "start")
    return positions.checkpointed(good.union(whole))


def parsed(found: DataFrame, parse: Callable[[str, int, int, str], Iterator], schema: str) -> DataFrame:
    """``parse(file, size, hi, start)`` of each range, giving Arrow batches of the schema."""

    def read(batches) -> Iterator:
        for b in batches:
            for file, size, hi, start in zip(*(b.column(c).to_pylist() for c in ("file", "size", "hi", "start"))):
                yield from parse(file, size, hi, start)

    return _spread(found).mapInArrow(read, schema)
