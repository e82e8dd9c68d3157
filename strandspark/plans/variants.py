"""Tools over variant records as :func:`strandspark.sources.vcf.read_vcf` returns them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.operators import ordered, positions

_EMPTY = "cast(array() as array<string>)"


# --- filters and rewriting of single records ---------------------------------------------------------------------------


def snps_only(df: DataFrame) -> DataFrame:
    """Records with a REF of one base and the ALTs that are one base; records without one are left out."""
    kept = F.filter("alts", lambda a: (a["sv_type"] == "NONE") & (F.length(a["alt"]) == 1))
    return df.where(F.length("ref") == 1).withColumn("alts", kept).where(F.size("alts") > 0)


def zygosity(df: DataFrame, k: int) -> DataFrame:
    """Records in which any sample has exactly k alleles that are not REF; null alleles are no ALT."""
    return df.where(F.exists("samples", lambda s: F.size(F.filter(s["gt"], lambda g: F.coalesce(g["alt"] > 0, F.lit(False)))) == k))


def sample_list(spark, path: str) -> list[str]:
    """Sample names of a text file, one a line."""
    return [r["value"].strip() for r in spark.read.text(path).where("trim(value) <> ''").toLocalIterator()]


def select_samples(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Keep or leave out samples by name; columns stay in file order. Neither list: all samples."""
    if include is None and exclude is None:
        return df
    names = F.array(*[F.lit(n) for n in (include if include is not None else exclude)]) if (include or exclude) else F.expr(_EMPTY)
    test = (lambda s: F.array_contains(names, s["name"])) if include is not None else (lambda s: ~F.array_contains(names, s["name"]))
    return df.withColumn("samples", F.filter("samples", test))


def prune_alts(df: DataFrame) -> DataFrame:
    """Drop ALTs that no sample has, renumber alleles from 1, leave out records without an ALT. An unused allele would be 0."""
    used = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("samples", lambda s: F.transform(s["gt"], lambda g: g["alt"]))), lambda a: a > 0)))
    pruned = df.withColumn("_used", used).where(F.size("_used") > 0)
    alts = F.transform("_used", lambda u: F.element_at("alts", u.cast("int")))
    number = lambda a: F.when(a.isNotNull(), F.when(a == 0, 0).otherwise(F.array_position("_used", a))).cast("smallint")
    samples = F.transform("samples", lambda s: s.withField("gt", F.transform(s["gt"], lambda g: g.withField("alt", number(g["alt"])))))
    return pruned.withColumn("samples", samples).withColumn("alts", alts).drop("_used")


def project_info(df: DataFrame, keys: list[str]) -> DataFrame:
    wanted = F.array(*[F.lit(k) for k in keys]) if keys else F.expr(_EMPTY)
    return df.withColumn("info_keys", F.filter("info_keys", lambda k: F.array_contains(wanted, k))).withColumn("info", F.map_filter("info", lambda k, v: F.array_contains(wanted, k)))


def project_format(df: DataFrame, keys: list[str]) -> DataFrame:
    wanted = F.array(*[F.lit(k) for k in keys])
    return df.withColumn("format", F.filter("format", lambda k: F.array_contains(wanted, k)))


def drop_with_info(df: DataFrame, keys: list[str]) -> DataFrame:
    """Leave out records in which any of the keys has a value (``.`` is none)."""
    return df.where(~F.coalesce(F.exists(F.array(*[F.coalesce(F.col("info")[k] != ".", F.lit(False)) for k in keys]), lambda x: x), F.lit(False)))


def fill_missing_ids(df: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """Missing IDs become prefix and a running number in the given order; records that are equal in it are ordered by REF and
    ALTs. Numbers run over a table of places and counts; only records without an ID are joined to it."""
    missing = df.where("ids IS NULL")
    places = missing.groupBy(*order).agg(F.count("*").alias("_count"))
    starts = positions.running_sum(places, list(order), "_count", "_upto").select(*[F.col(c).alias(f"_of_{c}") for c in order], (F.col("_upto") - F.col("_count")).alias("_start"))
    same = F.lit(True)
    for c in order:
        same = same & F.col(f"_of_{c}").eqNullSafe(F.col(c))
    inside = F.row_number().over(Window.partitionBy(*order).orderBy("ref", "alts"))
    numbered = missing.join(starts, same).withColumn("_in", inside)
    made = numbered.withColumn("ids", F.array(F.concat(F.lit(prefix), (F.col("_start") + F.col("_in")).cast("string")))).select(*df.columns)
    return df.where("ids IS NOT NULL").unionByName(made)


def in_bed(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Records whose position is in a region of the same chromosome."""
    return ordered.in_regions(df, ordered.merge_intervals(regions, ["chrom"], "begin", "end", large_groups=True), "chrom", F.col("pos") - 1)


def region_counts(df: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: records, those on a chromosome that no region is on, and those on others whose position is in none."""
    merged = ordered.merge_intervals(regions, ["chrom"], "begin", "end", large_groups=True)
    known = merged.select(F.col("chrom").alias("_known")).distinct()
    inside = ordered.in_regions(df, merged, "chrom", F.col("pos") - 1).agg(F.count("*").alias("_in"))
    seen = df.join(known, F.col("chrom") == F.col("_known"), "left").agg(F.count("*").alias("records"), F.count_if(F.col("_known").isNull()).alias("chrom_mismatches"))
    one = seen.crossJoin(F.broadcast(inside))  # a row each
    return one.select("records", "chrom_mismatches", (F.col("records") - F.col("chrom_mismatches") - F.col("_in")).alias("position_mismatches"))


def cat(df: DataFrame, *, chrom: str | None = None, regions: DataFrame | None = None, snps: bool = False, missing_id_prefix: str | None = None, include=None, exclude=None, zygosity_k: int | None = None, info: list[str] | None = None, omit_info: bool = False, formats: list[str] | None = None, order=("chrom", "pos")) -> DataFrame:
    """Filter and rewrite records; without options the records are unchanged."""
    if chrom is not None:
        df = df.where(F.col("chrom") == chrom)
    if regions is not None:
        df = in_bed(df, regions)
    if snps:
        df = snps_only(df)
    if missing_id_prefix is not None:
        df = fill_missing_ids(df, missing_id_prefix, list(order))
    if include is not None or exclude is not None:
        df = prune_alts(select_samples(df, include, exclude))
    if zygosity_k is not None:
        df = zygosity(df, zygosity_k)
    if omit_info or info is not None:
        df = project_info(df, [] if omit_info else info)
    return project_format(df, formats) if formats is not None else df


# --- statistics ----------------------------------------------------------------------------------------------------------


def distances(df: DataFrame, chrom: str) -> DataFrame:
    """Distance of each record of the chromosome to the one before."""
    return ordered.distances(df.where(F.col("chrom") == chrom).select("chrom", "pos"), ["chrom"], ["pos"], "pos", large_groups=True).select("pos", "distance")


def counts_per_copy(df: DataFrame, chrom: str) -> DataFrame:
    """Records with a non-REF allele by sample and chromosome copy, of any ploidy."""
    s = df.where(F.col("chrom") == chrom).select(F.explode("samples").alias("s"))
    g = s.select(F.col("s.name").alias("sample"), F.posexplode("s.gt").alias("copy", "g"))
    return g.groupBy("sample", "copy").agg(F.count_if(F.coalesce(F.col("g.alt") > 0, F.lit(False))).alias("n"))


def phase_sets(df: DataFrame, chrom: str) -> DataFrame:
    s = df.where(F.col("chrom") == chrom).select("pos", F.explode("samples").alias("s"))
    return s.select("pos", F.col("s.name").alias("sample"), F.col("s.fields")["PS"].try_cast("int").alias("ps"))


def phase_set_counts(df: DataFrame, chrom: str) -> DataFrame:
    """By sample, records of the chromosome with and without a phase set."""
    return phase_sets(df, chrom).groupBy("sample").agg(F.count("ps").alias("set"), F.count_if(F.col("ps").isNull()).alias("unset"))


def _private(group: list[str]) -> Column:
    """ALT alleles of a record that samples of the group have and no other sample has."""
    names = F.array(*[F.lit(n) for n in group])
    of = lambda inside: F.flatten(F.transform(F.filter("samples", lambda s: F.array_contains(names, s["name"]) == F.lit(inside)), lambda s: F.transform(s["gt"], lambda g: g["alt"])))
    return F.array_sort(F.array_except(F.filter(of(True), lambda a: a > 0), of(False)))


def private_variants(df: DataFrame, group: list[str]) -> DataFrame:
    """(chrom, pos, alt): ALT alleles of each record that samples of the group have and no other sample has; no shuffle."""
    return df.select("chrom", "pos", F.explode(_private(group)).alias("alt"))


def private_counts(df: DataFrame, group: list[str]) -> DataFrame:
    """(chrom, pos, n): how many each record has."""
    return df.select("chrom", "pos", F.size(_private(group)).cast("bigint").alias("n"))


def private_total(df: DataFrame, group: list[str]) -> DataFrame:
    """One row: how many all records have."""
    return private_counts(df, group).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


#: Colours of alleles in the genotype image: null, REF, then ALTs.
PALETTE = ["#808080", "#ffffff", "#1f3a93", "#c0392b", "#27ae60", "#f39c12", "#8e44ad", "#16a085"]


def genotype_cells(df: DataFrame, order: list[str]) -> DataFrame:
    """(record, row, allele, rgb): a column per record and a row per chromosome copy of each sample."""
    numbered = positions.numbered(df, order, "record").withColumn("record", F.col("record") - 1)
    s = numbered.select("record", F.posexplode("samples").alias("si", "s")).select("record", "si", F.posexplode("s.gt").alias("copy", "g"))
    colours = F.array(*[F.lit(x) for x in PALETTE])
    rgb = F.element_at(colours, F.least(F.coalesce(F.col("g.alt") + 2, F.lit(1)), F.lit(len(PALETTE))).cast("int"))
    return s.select("record", F.struct("si", "copy").alias("row"), F.col("g.alt").alias("allele"), rgb.alias("rgb"))


def write_image(df: DataFrame, order: list[str], path: str, most_cells: int = 1 << 26) -> tuple[int, int]:
    """Write the genotype cells as a TIFF file with a palette, a column per record and a row per copy; returns (columns, rows).
    An image is one file, so the driver draws it, from one byte a cell; beyond ``most_cells`` that is an error."""
    import struct

    numbered = positions.numbered(df, order, "record")
    cells = numbered.select("record", F.flatten(F.transform("samples", lambda s: F.transform(s["gt"], lambda g: F.least(F.coalesce(g["alt"] + 1, F.lit(0)), F.lit(len(PALETTE) - 1)).cast("int")))).alias("x"))
    width, height = cells.agg(F.count("*").alias("w"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("h")).first()
    if width * height > most_cells:
        raise ValueError(f"an image of {width} x {height} cells is too large for one file")
    pixels = [bytearray(width) for _ in range(height)]
    for r in cells.toLocalIterator():
        for y, x in enumerate(r["x"]):
            pixels[y][r["record"] - 1] = x
    rgb = [tuple(int(c[i : i + 2], 16) * 257 for i in (1, 3, 5)) for c in PALETTE] + [(0, 0, 0)] * (256 - len(PALETTE))
    data, palette = b"".join(bytes(p) for p in pixels), struct.pack("<768H", *(c[i] for i in range(3) for c in rgb))
    at = 8 + len(data)
    # Tags of the format, with their types (3: 16 bits, 4: 32 bits), counts and values
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 3), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, max(height, 1)), (279, 4, 1, len(data)), (320, 3, 768, at)]
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHI", b"II", 42, at + len(palette)) + data + palette + struct.pack("<H", len(tags)))
        f.write(b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0))
    return width, height


# --- against a reference ---------------------------------------------------------------------------------------------------

CHUNK = 1 << 16


def chunks(sequences: DataFrame) -> DataFrame:
    """(chrom, bin, chunk): reference sequences (id, seq) in pieces of ``CHUNK`` bases, white space and gaps removed. A sequence is
    divided in one pass."""
    clean = sequences.select(F.col("id").alias("chrom"), F.upper(F.regexp_replace("seq", r"[\s-]", "")).alias("seq"))
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return clean.select("chrom", F.posexplode(pieces).alias("bin", "chunk")).withColumn("bin", F.col("bin").cast("bigint"))


def reference_bases(df: DataFrame, sequences: DataFrame, pos0: Column, length: Column, name: str) -> DataFrame:
    """Add the reference's bases at a 0-based position, by an equi-join on (chrom, bin); null outside of it, and only
    what is there where it ends inside. Records are numbered
    in a written table, so that a number means the same record wherever it is read."""
    spans = F.sequence(F.floor(F.col("_p") / CHUNK), F.floor((F.col("_p") + F.greatest(F.col("_n"), F.lit(1)) - 1) / CHUNK))
    keyed = positions.checkpointed(df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", pos0).withColumn("_n", length))
    parts = keyed.where("_p >= 0").select("_id", F.col("chrom").alias("_c"), "_p", "_n", F.explode(spans).alias("_b"))
    ref = chunks(sequences)
    hit = parts.join(ref, (F.col("_c") == ref["chrom"]) & (F.col("_b") == ref["bin"]))
    lo, hi = F.greatest(F.col("_p") - F.col("_b") * CHUNK, F.lit(0)), F.least(F.col("_p") + F.col("_n") - F.col("_b") * CHUNK, F.lit(CHUNK))
    piece = F.struct("_b", F.substr("chunk", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    bases = hit.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["x"]), "").alias(name))
    inside = F.when((F.col("_n") <= 0) | (F.col(name) != ""), F.col(name))
    return keyed.join(bases, "_id", "left").withColumn(name, inside).drop("_id", "_p", "_n")


def with_expected(df: DataFrame, sequences: DataFrame) -> DataFrame:
    """Add ``expected``: what the reference has in REF's place (null where it has no such place)."""
    return reference_bases(df, sequences, F.col("pos") - 1, F.length("ref"), "expected")


def check_reference(df: DataFrame, sequences: DataFrame, chrom: str | None = None) -> DataFrame:
    """Records whose REF differs from the reference (null where it has no such place)."""
    at = with_expected(df if chrom is None else df.where(F.col("chrom") == chrom), sequences)
    return at.where(~F.col("ref").eqNullSafe(F.col("expected"))).select("chrom", "pos", "ref", "expected")


def reference_counts(df: DataFrame, sequences: DataFrame, chrom: str | None = None) -> DataFrame:
    """One row by chromosome: records, those whose REF is the reference's, and those whose is not. Records of chromosomes other than
    ``chrom`` are counted as such: checked is false and nothing else is counted."""
    checked = F.lit(True) if chrom is None else F.col("chrom") == chrom
    at = with_expected(df, sequences).withColumn("checked", checked).withColumn("_same", F.col("ref").eqNullSafe(F.col("expected")))
    return at.groupBy("chrom", "checked").agg(F.count("*").alias("records"), F.count_if(F.col("checked") & F.col("_same")).alias("matches"), F.count_if(F.col("checked") & ~F.col("_same")).alias("mismatches"))


def convert_deletions(df: DataFrame, sequences: DataFrame) -> DataFrame:
    """Records with a <DEL>: the base before is set in front of REF and ALTs and the position moves by one, or, at the first
    base, the base after is appended. Other structural types are an error."""
    deleted = F.exists("alts", lambda a: a["sv_type"].isin("DEL", "DEL_ME"))
    other = F.exists("alts", lambda a: ~a["sv_type"].isin("NONE", "DEL", "DEL_ME"))
    first = F.col("pos") == 1
    at = reference_bases(df.withColumn("_del", deleted), sequences, F.when(first, F.length("ref")).otherwise(F.col("pos") - 2), F.lit(1), "_base")
    text = lambda a: F.when(a["sv_type"] == "NONE", a["alt"]).otherwise("")
    placed = lambda x: F.when(first, F.concat(x, "_base")).otherwise(F.concat("_base", x))
    alts = F.transform("alts", lambda a: F.struct(placed(text(a)).alias("alt"), F.lit("NONE").alias("sv_type")))
    bad = F.when(other, F.raise_error(F.lit("a structural variant other than a deletion")).cast("string"))
    out = at.withColumn("ref", F.coalesce(bad, F.when(F.col("_del"), placed(F.col("ref"))).otherwise(F.col("ref"))))
    return out.withColumn("alts", F.when(F.col("_del"), alts).otherwise(F.col("alts"))).withColumn("pos", F.when(F.col("_del") & ~first, F.col("pos") - 1).otherwise(F.col("pos"))).drop("_del", "_base")


def concatenate(df: DataFrame, sequences: DataFrame) -> DataFrame:
    """Adjacent haploid ALT records of one sample folded into one; overlapping ones are skipped, an empty ALT is anchored at
    the base before."""
    allele = F.element_at("samples", 1)["gt"][0]["alt"]
    alt = F.when(allele > 0, F.element_at("alts", allele.cast("int"))["alt"])
    rows = df.withColumn("alt", alt).where("alt IS NOT NULL AND alt <> ref").select("chrom", "ref", "alt", (F.col("pos") - 1).alias("begin"), (F.col("pos") - 1 + F.length("ref")).alias("end"))
    folded = ordered.fold_adjacent(rows.withColumn("at", F.col("begin")), ["chrom"], ["at", "ref", "alt"], "begin", "end", [], large_groups=True)
    part = F.struct("at", "ref", "alt")
    joined = folded.groupBy("chrom", "chain").agg(F.min("begin").alias("begin"), F.array_sort(F.collect_list(part)).alias("p"))
    text = lambda k: F.array_join(F.transform("p", lambda x: x[k]), "")
    out = joined.select("chrom", (F.col("begin") + 1).alias("pos"), text("ref").alias("ref"), text("alt").alias("alt"))
    at = reference_bases(out, sequences, F.when(F.col("alt") == "", F.col("pos") - 2).otherwise(-1), F.lit(1), "_base")
    anchor = (F.col("alt") == "") & F.col("_base").isNotNull()
    return at.select("chrom", F.when(anchor, F.col("pos") - 1).otherwise(F.col("pos")).alias("pos"), F.when(anchor, F.concat("_base", "ref")).otherwise(F.col("ref")).alias("ref"), F.when(anchor, F.col("_base")).otherwise(F.col("alt")).alias("alt"))


#: Copies in a word of bits; all of them are non-negative.
_WORD = 62


# --- merging -------------------------------------------------------------------------------------------------------------


def merge_records(df: DataFrame, skip_info: list[str] | None = None) -> DataFrame:
    """Genotypes of records with equal (chrom, pos, ref, alt) merged: a copy carries the allele if any record says so. In
    unphased samples alleles are sorted, 0 first; records that differ in samples, phase or ploidy are an error. Null alleles are 0.

    A record's copies are bits, ``_WORD`` of them a word, and words are merged by OR before the shuffle; the samples' names,
    phases and ploidies go once a record, as the least and the greatest, which have to be equal."""
    if skip_info:
        df = drop_with_info(df, skip_info)
    one = df.select("chrom", "pos", "ref", F.posexplode("alts.alt").alias("ai", "alt"), "samples")
    carries = lambda s: F.transform(s["gt"], lambda g: F.when(g["alt"] == F.col("ai") + 1, "1").otherwise("0"))
    phased = lambda s: F.exists(F.slice(s["gt"], F.lit(2), F.greatest(F.size(s["gt"]) - 1, F.lit(0))), lambda g: g["phased"])
    bits = F.array_join(F.transform("samples", lambda s: F.array_join(F.when(phased(s), carries(s)).otherwise(F.array_sort(carries(s))), "")), "")
    kind = F.transform("samples", lambda s: F.struct(s["name"].alias("name"), phased(s).alias("phased"), F.size(s["gt"]).alias("ploidy")))
    words = F.posexplode_outer(F.regexp_extract_all("bits", F.lit(f".{{1,{_WORD}}}"), F.lit(0))).alias("w", "word")
    flat = one.select("chrom", "pos", "ref", "alt", bits.alias("bits"), kind.alias("kind")).select("chrom", "pos", "ref", "alt", "kind", words)
    flat = flat.withColumn("size", F.length("word")).withColumn("word", F.conv("word", 2, 10).cast("bigint")).withColumn("kind", F.when(F.coalesce(F.col("w"), F.lit(0)) == 0, F.col("kind")))
    key = ["chrom", "pos", "ref", "alt"]
    merged = flat.groupBy(*key, "w").agg(F.bit_or("word").alias("word"), F.max("size").alias("size"), F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    part = F.struct("w", F.lpad(F.bin("word"), F.col("size"), "0").alias("x"))
    out = merged.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["x"]), "").alias("bits"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    kinds = F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("lo")).otherwise(F.raise_error(F.lit("merged records differ in samples, phase or ploidy")).cast(out.schema["lo"].dataType))
    before = lambda i: F.aggregate(F.slice("lo", F.lit(1), i), F.lit(0), lambda n, k: n + k["ploidy"])
    gt = lambda k, i: F.transform(F.when(k["ploidy"] > 0, F.split(F.substr("bits", before(i) + 1, k["ploidy"]), "")), lambda x: x.cast("int"))
    samples = F.transform("lo", lambda k, i: F.struct(k["name"].alias("name"), gt(k, i).alias("gt"), k["phased"].alias("phased")))
    return out.withColumn("lo", kinds).select(*key, F.array_sort(samples).alias("samples"))


def metadata_conflicts(headers: list) -> list[str]:
    """What keeps inputs from being merged: differing contig lengths, or number or type of a field."""
    out = []
    for kind, keys in (("contig", ("length",)), ("INFO", ("Number", "Type")), ("FORMAT", ("Number", "Type"))):
        seen: dict[str, tuple] = {}
        for h in headers:
            for i, e in h.of(kind).items():
                value = tuple(e.get(k) for k in keys)
                if seen.setdefault(i, value) != value:
                    out.append(f"{kind} {i}: {seen[i]} and {value}")
    return out


def merge_files(frames: list[DataFrame], headers: list, generate_samples: bool = False, ploidy: int = 1) -> DataFrame:
    """Records of all inputs by contig, position and input. Generated: a sample per input, 1 in its own records and 0 in others;
    else every input's samples, 0 outside of their own records, renamed ``SAMPLE<i>.<j>`` where names repeat."""
    if conflicts := metadata_conflicts(headers):
        raise ValueError("; ".join(conflicts))
    contigs: dict[str, int] = {}
    for h in headers:
        for i in h.of("contig"):
            contigs.setdefault(i, len(contigs))
    names = [n for h in headers for n in h.samples]
    unique = len(set(names)) == len(names)
    out = None
    for i, (f, _) in enumerate(zip(frames, headers)):
        parts = []
        for j, g in enumerate(headers):
            if generate_samples:
                gt = F.array(*[F.struct(F.lit(int(i == j)).cast("smallint").alias("alt"), F.lit(k > 0).alias("phased")) for k in range(ploidy)])
                parts.append(F.array(F.struct(F.lit(f"SAMPLE{j + 1}").alias("name"), gt.alias("gt"))))
                continue
            for k, n in enumerate(g.samples):
                name = F.lit(n if unique else f"SAMPLE{j + 1}.{k + 1}").alias("name")
                zero = F.array(F.struct(F.lit(0).cast("smallint").alias("alt"), F.lit(False).alias("phased")))
                parts.append(F.array(F.struct(name, (F.col("samples")[k]["gt"] if i == j else zero).alias("gt"))))
        one = f.select("chrom", "pos", "ids", "ref", "alts", "qual", "filters", F.lit(i).alias("file_idx"), F.concat(*parts).alias("samples"))
        out = one if out is None else out.unionByName(one)
    place = F.coalesce(*[F.when(F.col("chrom") == k, F.lit(v)) for k, v in contigs.items()], F.lit(len(contigs)))
    return out.orderBy(place, "chrom", "pos", "file_idx")
