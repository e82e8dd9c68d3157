"""VCF records from files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.sources.vcf import Header, records


def read_stream(spark: SparkSession, folder: str, header: Header, mode: str = "DROPMALFORMED") -> DataFrame:
    """Records of all files as they arrive; their headers have to agree with ``header``."""
    return records(spark.readStream.text(folder), header, mode)


def running_counts(stream: DataFrame) -> DataFrame:
    """Records and SNPs by chromosome so far (a stateful aggregate with one row a chromosome)."""
    snp = (F.length("ref") == 1) & F.exists("alts", lambda a: F.length(a["alt"]) == 1)
    return stream.groupBy("chrom").agg(F.count("*").alias("records"), F.count_if(snp).alias("snps"))
