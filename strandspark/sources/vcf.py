"""VCF text files as typed DataFrames, and back. Parsing is by Catalyst expressions; only the header is read on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandspark.operators import positions

# Reserved keys of the format, as (id, number, type).
RESERVED_INFO = [
    ("AA", "1", "String"), ("AC", "A", "Integer"), ("AD", "R", "Integer"), ("ADF", "R", "Integer"), ("ADR", "R", "Integer"), ("AF", "A", "Float"),
    ("AN", "1", "Integer"), ("BQ", "1", "Float"), ("CIGAR", "A", "String"), ("DB", "0", "Flag"), ("DP", "1", "Integer"), ("END", "1", "Integer"),
    ("H2", "0", "Flag"), ("H3", "0", "Flag"), ("MQ", "1", "Float"), ("MQ0", "1", "Integer"), ("NS", "1", "Integer"), ("SB", "4", "Integer"),
    ("SOMATIC", "0", "Flag"), ("VALIDATED", "0", "Flag"), ("1000G", "0", "Flag"),
]
RESERVED_FORMAT = [
    ("AD", "R", "Integer"), ("ADF", "R", "Integer"), ("ADR", "R", "Integer"), ("DP", "1", "Integer"), ("EC", "A", "Integer"), ("FT", "1", "String"),
    ("GL", "G", "Float"), ("GP", "G", "Float"), ("GQ", "1", "Integer"), ("GT", "1", "String"), ("HQ", "2", "Integer"), ("MQ", "1", "Integer"),
    ("PL", "G", "Integer"), ("PQ", "1", "Integer"), ("PS", "1", "Integer"),
]
SV_TYPES = ["DEL", "INS", "DUP", "INV", "CNV", "DUP:TANDEM", "DEL:ME", "INS:ME"]
FIXED = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
_TYPES = {"Integer": "int", "Float": "float", "Character": "string", "String": "string", "Flag": "boolean"}


@dataclass
class Header:
    """Metadata entries in file order (dicts with kind and the line's fields) and sample names."""

    version: str = "VCFv4.3"
    entries: list[dict[str, str]] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)

    def of(self, kind: str) -> dict[str, dict[str, str]]:
        """Entries by ID; the first of equal ids counts. Reserved keys that the file does not declare come last."""
        out: dict[str, dict[str, str]] = {}
        for e in self.entries:
            if e["kind"] == kind:
                out.setdefault(e.get("ID", ""), e)
        for i, n, t in {"INFO": RESERVED_INFO, "FORMAT": RESERVED_FORMAT}.get(kind, []):
            out.setdefault(i, {"kind": kind, "ID": i, "Number": n, "Type": t, "reserved": "1"})
        return out

    def text(self) -> list[str]:
        order = ["assembly", "INFO", "FILTER", "FORMAT", "ALT", "contig"]
        lines = [f"##fileformat={self.version}"]
        for e in sorted((e for e in self.entries if e["kind"] in order), key=lambda e: order.index(e["kind"])):
            if e["kind"] == "assembly":
                lines.append(f"##assembly={e['value']}")
                continue
            parts = [f'{k}="{v}"' if k in ("Description", "Source", "Version") else f"{k}={v}" for k, v in e.items() if k != "kind"]
            lines.append(f"##{e['kind']}=<{','.join(parts)}>")
        names = FIXED + (["FORMAT", *self.samples] if self.samples else [])
        return [*lines, "#" + "\t".join(names)]


def parse_header(lines: list[str]) -> Header:
    h = Header()
    if not lines or not re.match(r"##fileformat=VCFv4\.\d+$", lines[0]):
        raise ValueError("the first line has to be ##fileformat=VCFv4.<n>")
    h.version = lines[0].partition("=")[2]
    for line in lines[1:]:
        if m := re.match(r"##(INFO|FORMAT|FILTER|ALT|contig)=<(.*)>$", line):
            pairs = re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)', m[2])
            h.entries.append({"kind": m[1], **{k: v[1:-1] if v.startswith('"') else v for k, v in pairs}})
        elif line.startswith("##assembly="):
            h.entries.append({"kind": "assembly", "value": line.partition("=")[2]})
        elif line.startswith("#CHROM"):
            h.samples = line.split("\t")[9:]
            if len(set(h.samples)) < len(h.samples):
                raise ValueError("sample names repeat")
    return h


def read_header(spark: SparkSession, path: str) -> Header:
    """Reads the first lines, more and more until one is not a header line."""
    n = 256
    while True:
        lines = [r["value"] for r in spark.read.text(path).limit(n).collect()]
        head = [x for x in lines if x.startswith("#")]
        if len(head) < len(lines) or len(lines) < n:
            return parse_header(head)
        n *= 8


def meta_table(spark: SparkSession, header: Header, file: str = "") -> DataFrame:
    keys = ["kind", "ID", "Number", "Type", "Description", "Source", "Version", "length"]
    rows = [(file, i, *[e.get(k) for k in keys]) for i, e in enumerate(header.entries)]
    return spark.createDataFrame(rows, "file string, header_index int, " + ", ".join(f"{k.lower()} string" for k in keys))


def sample_table(spark: SparkSession, header: Header, file: str = "") -> DataFrame:
    return spark.createDataFrame([(file, i, s) for i, s in enumerate(header.samples)], "file string, sample_idx int, name string")


def sv_type(alt: Column) -> Column:
    """Type of an ALT: NONE for bases and *, UNKNOWN for ., else by its symbol."""
    name = F.regexp_extract(alt, r"^<([^>]+)>$", 1)
    known = F.coalesce(*[F.when((name == s) | name.startswith(s + ":"), F.lit(s.replace(":", "_"))) for s in sorted(SV_TYPES, key=len, reverse=True)])
    return F.when(alt == ".", "UNKNOWN").when(name != "", F.coalesce(known, F.lit("UNKNOWN_SV"))).otherwise("NONE")


def sv_type_text(kind: Column) -> Column:
    """The symbol of a structural type, as :func:`sv_type` names it; null for types that have none."""
    return F.coalesce(*[F.when(kind == t.replace(":", "_"), F.lit(f"<{t}>")) for t in SV_TYPES])


def genotype(text: Column) -> Column:
    """GT text as array of (alt, phased); a null allele has a null alt, the first allele's phased is false."""
    alleles = F.regexp_extract_all(text, F.lit(r"([|/]?)(\d+|\.)"), F.lit(0))
    one = lambda a: F.struct(F.regexp_extract(a, r"(\d+)", 1).try_cast("smallint").alias("alt"), a.startswith("|").alias("phased"))
    return F.when(text.rlike(r"^(\d+|\.)([|/](\d+|\.))*$"), F.transform(alleles, one))


def genotype_text(gt: Column) -> Column:
    """``.`` for null; each allele after the first has its own separator."""
    parts = F.transform(gt, lambda g, i: F.concat(F.when(i == 0, "").when(g["phased"], "|").otherwise("/"), F.coalesce(g["alt"].cast("string"), F.lit("."))))
    return F.array_join(parts, "")


def typed(value: Column, number: str, kind: str) -> Column:
    """A text value by its declared number and type; ``.`` is null, also inside vectors; malformed numbers are null."""
    t = _TYPES.get(kind, "string")
    cast = (lambda v: F.when(v != ".", v)) if t == "string" else (lambda v: v.try_cast(t))
    if number in ("A", "R", "G", ".") or number.isdigit() and int(number) > 1:
        return F.when(value != ".", F.transform(F.split(value, ","), cast))
    return cast(value)


def info_struct(header: Header, info: str = "info", keys: list[str] | None = None) -> Column:
    """INFO as a struct of typed fields; flags are never null."""
    fields = []
    for k, e in header.of("INFO").items():
        if (keys is None and "reserved" in e) or (keys is not None and k not in keys):
            continue
        v = F.col(info)[k]
        fields.append((F.coalesce(F.map_contains_key(info, k), F.lit(False)) if e.get("Type") == "Flag" else typed(v, e.get("Number", "0"), e.get("Type", "String"))).alias(k))
    return F.struct(*fields)


def sample_field(header: Header, sample: Column, key: str) -> Column:
    e = header.of("FORMAT")[key]
    return typed(sample["fields"][key], e.get("Number", "0"), e.get("Type", "String"))


def read_vcf(spark: SparkSession, path: str | list[str], header: Header | None = None, mode: str = "PERMISSIVE", lineno: bool = False, upto: str | None = None) -> DataFrame:
    """One row per record: chrom, pos, ids, ref, alts, qual, filters, info_keys, info, format, samples, _error.

    ``mode``: PERMISSIVE keeps malformed records with ``_error``, DROPMALFORMED leaves them out, FAILFAST raises.
    ``lineno`` adds the 1-based number of the line in its file (the lines are written once). ``upto`` names the last column
    that is parsed (one of ``FIXED``); columns after it are null and their text is not divided."""
    header = header or read_header(spark, path if isinstance(path, str) else path[0])
    lines = spark.read.text(path)
    if lineno:
        place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
        lines = positions.numbered(lines.select("value", *place), ["_block", "_at"], "lineno", ["_file"]).select("value", "lineno")
    return records(lines, header, mode, lineno, upto)


def iterate(df: DataFrame) -> Iterator[Row]:
    """Records one after the other on the driver, a partition at a time; stopping early leaves the rest unread."""
    return df.toLocalIterator()


def records(lines: DataFrame, header: Header, mode: str = "PERMISSIVE", lineno: bool = False, upto: str | None = None) -> DataFrame:
    """Lines (column value, and lineno if asked for) as records; works on streams too. Of a repeated INFO or FORMAT key the first
    counts, and the record is malformed."""
    last = len(FIXED) if upto is None else FIXED.index(upto) + 1
    if upto is not None:
        # the rest of a line stays one piece, and is cut off
        header = Header(header.version, header.entries, [])
        lines = lines.withColumn("value", F.concat_ws("\t", F.slice(F.split("value", "\t", last + 1), 1, last), *[F.lit(".") for _ in range(len(FIXED) - last)]))
    rows = lines.where("value <> '' AND NOT startswith(value, '#')").withColumn("c", F.split("value", "\t"))
    col = lambda i: F.get("c", F.lit(i))
    listed = lambda v, sep: F.when(v != ".", F.split(v, sep))
    pairs = F.transform(listed(col(7), ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.instr(x, "=") > 0, F.substr(x, F.instr(x, "=") + 1)).alias("v")))
    info_names = F.transform(pairs, lambda p: p["k"])
    first_pairs = F.filter(pairs, lambda p, i: F.array_position(info_names, p["k"]) == i + 1)
    n = len(header.samples)
    names = F.array(*[F.lit(s) for s in header.samples]) if n else F.expr("cast(array() as array<string>)")
    fmt = F.split(col(8), ":")
    fields = lambda s: F.map_from_entries(F.filter(F.arrays_zip(fmt.alias("k"), F.split(s, ":").alias("v")), lambda p, i: p["k"].isNotNull() & p["v"].isNotNull() & (F.array_position(fmt, p["k"]) == i + 1)))
    samples = F.zip_with(names, F.slice("c", 10, max(n, 1)) if n else names, lambda name, s: F.struct(name.alias("name"), fields(s).alias("fields"), genotype(fields(s)["GT"]).alias("gt")))
    gt_bad = F.exists(F.coalesce("samples", F.lit(None)), lambda s: F.exists(s["gt"], lambda g: g["alt"] > F.size("alts")))
    info_known, format_known, filter_known = (F.array(*[F.lit(k) for k in header.of(x)] or [F.lit("")]) for x in ("INFO", "FORMAT", "FILTER"))
    error = F.concat_ws(
        "; ",
        F.when(F.size("c") < 8, "too few columns"),
        F.when(F.col("_repeated"), "INFO key repeats"),
        F.when(F.lit(n > 0) & (F.size(F.array_distinct("format")) < F.size("format")), "FORMAT key repeats"),
        F.when((F.size("c") >= 8) & (F.size("c") != 8 + (n + 1 if n else 0)) & F.lit(n > 0), "wrong number of sample columns"),
        F.when(col(1).try_cast("bigint").isNull() | (col(1).try_cast("bigint") < 0), "POS is not a position"),
        F.when(~col(3).rlike("^[ACGTNacgtn]+$"), "REF has other characters than ACGTN"),
        F.when(~col(4).rlike(r"^(\.|\*|[ACGTNacgtn]+|<[^<>]+>)(,(\*|[ACGTNacgtn]+|<[^<>]+>))*$"), "ALT is malformed"),
        F.when((col(5) != ".") & col(5).try_cast("double").isNull(), "QUAL is not a number"),
        F.when(F.size(F.array_except(F.map_keys("info"), info_known)) > 0, "INFO key is not declared"),
        F.when(F.lit(n > 0) & (F.size(F.array_except("format", format_known)) > 0), "FORMAT key is not declared"),
        F.when(F.size(F.array_except("filters", filter_known)) > 0, "FILTER is not declared"),
        F.when(gt_bad, "allele above the number of ALTs"),
    )
    out = rows.select(
        *(["lineno"] if lineno else []), "c", col(0).alias("chrom"), col(1).try_cast("bigint").alias("pos"), listed(col(2), ";").alias("ids"), F.upper(col(3)).alias("ref"),
        F.transform(F.split(col(4), ","), lambda a: F.struct(a.alias("alt"), sv_type(a).alias("sv_type"))).alias("alts"),
        F.when(col(5) != ".", col(5).try_cast("double")).alias("qual"), F.when(col(6) == "PASS", F.expr("cast(array() as array<string>)")).otherwise(listed(col(6), ";")).alias("filters"),
        F.array_distinct(info_names).alias("info_keys"), (F.size(first_pairs) < F.size(pairs)).alias("_repeated"), F.map_from_entries(F.transform(first_pairs, lambda p: F.struct(p["k"], F.coalesce(p["v"], F.lit("")).alias("v")))).alias("info"),
        (fmt if n else F.expr("cast(array() as array<string>)")).alias("format"), samples.alias("samples"),
    )
    out = out.withColumn("_error", F.nullif(error, F.lit(""))).drop("c", "_repeated")
    if upto is not None:
        gone = {"QUAL": ["qual"], "FILTER": ["filters"], "INFO": ["info_keys", "info"], "ID": ["ids"], "REF": ["ref"], "ALT": ["alts"], "POS": ["pos"]}
        empty = [c for k in FIXED[last:] for c in gone[k]] + ["format", "samples"]
        out = out.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in empty})
        if "alts" in empty:  # what was not parsed is not malformed
            out = out.withColumn("_error", F.lit(None).cast("string"))
    if mode == "DROPMALFORMED":
        return out.where("_error IS NULL").drop("_error")
    if mode == "FAILFAST":
        return out.withColumn("chrom", F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error")).cast("string")).otherwise(F.col("chrom"))).drop("_error")
    return out


def variant_end(df: DataFrame) -> Column:
    """END if it is set, else the 0-based position plus the length of REF."""
    return F.coalesce(F.col("info")["END"].try_cast("bigint"), F.col("pos") - 1 + F.length("ref"))


def record_text(df: DataFrame, has_samples: bool) -> DataFrame:
    """Records as lines."""
    dot = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("."))
    info = F.array_join(F.transform("info_keys", lambda k: F.when(F.col("info")[k] == "", k).otherwise(F.concat(k, F.lit("="), F.col("info")[k]))), ";")
    values = lambda s: F.array_join(F.transform("format", lambda k: F.when(k == "GT", genotype_text(s["gt"])).otherwise(F.coalesce(s["fields"][k], F.lit(".")))), ":")
    qual = F.when(F.col("qual") == F.floor("qual"), F.col("qual").cast("bigint").cast("string")).otherwise(F.col("qual").cast("string"))
    cols = [
        F.col("chrom"), F.col("pos").cast("string"), dot(F.array_join("ids", ";")), F.col("ref"), F.array_join(F.transform("alts", lambda a: a["alt"]), ","), dot(qual),
        F.when(F.col("filters").isNull(), ".").when(F.size("filters") == 0, "PASS").otherwise(F.array_join("filters", ";")), dot(info),
    ]
    if has_samples:
        cols += [F.array_join("format", ":"), F.array_join(F.transform("samples", values), "\t")]
    return df.select(F.concat_ws("\t", *cols).alias("value"))


def write_vcf(df: DataFrame, header: Header, path: str, order: list[str] | None = None) -> None:
    """A folder of text parts whose first holds the header, so that the parts in order are one file."""
    body = record_text(df.orderBy(*order) if order else df, bool(header.samples))
    head = df.sparkSession.createDataFrame([(x,) for x in header.text()], "value string").coalesce(1)
    head.union(body).write.text(path)


