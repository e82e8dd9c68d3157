"""Whole tools: from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.operators import pbwt
from strandspark.plans import variants
from strandspark.sources import sam, sequences, vcf


def vcfcat(spark: SparkSession, inputs: list[str], output: str, *, bed: str | None = None, include_file: str | None = None, exclude_file: str | None = None, include=None, exclude=None, mode: str = "FAILFAST", **options) -> None:
    """Read VCF files, filter and rewrite their records (see :func:`strandspark.plans.variants.cat`), and write them as one file in
    parts. The inputs have to agree in their metadata and samples; sample lists may come from files, one name a line."""
    headers = [vcf.read_header(spark, p) for p in inputs]
    if conflicts := variants.metadata_conflicts(headers):
        raise ValueError("; ".join(conflicts))
    if any(h.samples != headers[0].samples for h in headers):
        raise ValueError("the inputs have different samples")
    include = variants.sample_list(spark, include_file) if include_file else include
    exclude = variants.sample_list(spark, exclude_file) if exclude_file else exclude
    regions = sequences.read_bed(spark, bed) if bed else None
    header = vcf.Header(headers[0].version, headers[0].entries, list(headers[0].samples))
    if include is not None:
        header.samples = [n for n in header.samples if n in include]
    if exclude is not None:
        header.samples = [n for n in header.samples if n not in exclude]
    frames = None
    for i, (path, h) in enumerate(zip(inputs, headers)):
        one = vcf.read_vcf(spark, path, h, mode).withColumn("_input", F.lit(i))
        frames = one if frames is None else frames.unionByName(one)
    out = variants.cat(frames, regions=regions, include=include, exclude=exclude, **options)
    contigs = {c: i for i, c in enumerate(headers[0].of("contig"))}
    place = F.coalesce(*[F.when(F.col("chrom") == k, F.lit(v)) for k, v in contigs.items()], F.lit(len(contigs)))
    vcf.write_vcf(out.withColumn("_place", place), header, output, ["_place", "chrom", "pos", "_input"])


def msa_identity_regions(spark: SparkSession, fasta: str, least: int, ignore_n: bool = False) -> DataFrame:
    """(position, leader, row_idx, length) of the aligned sequences of a FASTA file, numbered in file order; with ``ignore_n``, an N
    ends an agreement."""
    rows = sequences.read_fasta(spark, fasta).select(F.col("record_idx").alias("row_idx"), "seq")
    return pbwt.identity_regions(rows, least, "N" if ignore_n else "")


def write_identity_report(regions: DataFrame, path: str) -> None:
    """Tab-separated lines in the order of position, matched and matching sequence, under a line of titles."""
    body = regions.orderBy("position", "leader", "row_idx").select(F.concat_ws("\t", "position", "leader", "row_idx", "length").alias("value"))
    titles = regions.sparkSession.createDataFrame([("Position\tMatched string\tMatching string\tMatch length",)], "value string").coalesce(1)
    titles.union(body).write.text(path)


def sort_sam(spark: SparkSession, path: str, output: str, mode: str = "FAILFAST") -> None:
    """Records by reference, in the header's order, and position; records without a place come last."""
    header = sam.read_header(spark, path)
    records = sam.with_reference(sam.read_sam(spark, path, mode), sam.references(spark, header))
    done = [(k, {**f, "SO": "coordinate"} if k == "HD" else f) for k, f in header]
    sam.write_sam(records.orderBy(F.col("rname_id").asc_nulls_last(), "pos0", "qname"), done, output)
