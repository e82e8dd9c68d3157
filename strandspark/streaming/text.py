"""SAM and FASTA records from files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.sources import sam


def read_sam_stream(spark: SparkSession, folder: str, mode: str = "DROPMALFORMED") -> DataFrame:
    """SAM records of all files as they arrive."""
    return sam.records(spark.readStream.text(folder), mode)


def read_fasta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(id, extra, seq) of all files as they arrive; a file's records are divided at ``>`` at the start of a line."""
    parts = spark.readStream.option("lineSep", "\n>").text(folder).select(F.regexp_replace(F.regexp_replace("value", r"\r", ""), r"^\s*>", "").alias("v"))
    names = F.split(F.trim(F.substring_index("v", "\n", 1)), r"\s+")
    seq = F.when(F.instr("v", "\n") > 0, F.regexp_replace(F.substr("v", F.instr("v", "\n") + 1), r"\s", "")).otherwise("")
    return parts.where("trim(v) <> ''").select(F.get(names, F.lit(0)).alias("id"), F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))).alias("extra"), seq.alias("seq"))


def mapped_counts(stream: DataFrame) -> DataFrame:
    """Records and primary records by reference so far (a stateful aggregate with one row a reference)."""
    return stream.groupBy("rname").agg(F.count("*").alias("records"), F.count_if(sam.is_primary()).alias("primary"))
