"""Allocation logs: a header with the names of states, then big-endian 64-bit events."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event types.
EVENTS = ["unknown", "allocated_amount", "marker"]


def event_fields(word: Column) -> Column:
    """last in series (1 bit), type (7 bits), data (56 bits) of an event word."""
    return F.struct((F.shiftrightunsigned(word, 63) == 1).alias("last"), F.shiftright(word, 56).bitwiseAND(127).cast("int").alias("type"), word.bitwiseAND((1 << 56) - 1).alias("data"))


def series_rows(words: DataFrame, order: str = "at", word: str = "word") -> DataFrame:
    """(series, ms, type, data): words in order are grouped to series, which end with a word marked last; a series' first word is its
    time in milliseconds."""
    from pyspark.sql import Window

    e = words.select("file", order, event_fields(F.col(word)).alias("e")).select("file", order, "e.*")
    w = Window.partitionBy("file").orderBy(order)
    s = e.withColumn("series", F.coalesce(F.sum(F.col("last").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("file", "series").orderBy(order)
    return s.withColumn("ms", F.first("data").over(inside)).withColumn("_i", F.row_number().over(inside)).where("_i > 1").drop("_i", "last")


def read_log(spark, path: str) -> DataFrame:
    """(file, seconds, event, data) of logs: u64 version 1, u64 number of state names, each a u64 length and bytes; then events. A
    marker's data is the name of its state."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def parsed(batches):
        import pandas as pd

        for b in batches:
            for file, content in zip(b["file"], b["content"]):
                version, n = struct.unpack_from(">QQ", content)
                if version != 1:
                    raise ValueError("unknown version of the log")
                at, names = 16, []
                for _ in range(n):
                    size = struct.unpack_from(">Q", content, at)[0]
                    names.append(content[at + 8 : at + 8 + size].decode())
                    at += 8 + size
                words = struct.unpack_from(f">{(len(content) - at) // 8}q", content, at)
                for lo in range(0, len(words), 65536):
                    part = words[lo : lo + 65536]
                    yield pd.DataFrame({"file": file, "at": range(lo, lo + len(part)), "word": part, "names": [names] * len(part)})

    words = files.mapInPandas(parsed, "file string, at bigint, word bigint, names array<string>")
    rows = series_rows(words.select("file", "at", "word"))
    named = rows.join(words.select("file", "at", "names"), ["file", "at"])
    data = F.when(F.col("type") == 2, F.get("names", F.col("data").cast("int"))).otherwise(F.col("data").cast("string"))
    return named.select("file", "at", F.floor(F.col("ms") / 1000).alias("seconds"), F.coalesce(F.get(F.array(*[F.lit(x) for x in EVENTS]), F.col("type")), F.lit("unknown")).alias("event"), data.alias("data"))
