"""FASTA, FASTQ, BED, delimited, SAM, BAM and log sources."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandspark.functions import bits, text
from strandspark.sources import alloclog, ranges, sam, sequences, vcf


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize(
    "data, want",
    [
        (">a x y\nACGT\n>b\nAC\nGT\n", [("a", ["x", "y"], "ACGT"), ("b", [], "ACGT")]),
        ("ACGT\nAA\n", [(None, None, "ACGTAA")]),
        ("ACGT", [(None, None, "ACGT")]),
        (">a\nACGT", [("a", [], "ACGT")]),
        (">a", [("a", [], "")]),
        (";a\nAC\n;b\nGT\n", [("a", [], "AC"), ("b", [], "GT")]),
        ("", []),
    ],
)
def test_fasta(spark, tmp_path, data, want):
    rows = sequences.read_fasta(spark, write(tmp_path / "x.fa", data)).orderBy("record_idx").collect()
    assert [(r["id"], r["extra"] if r["id"] else None, r["seq"]) for r in rows] == want


def test_ranges_that_do_not_meet(spark):
    """A search that goes wrong, in the middle or at the end of a file, makes the file one range."""
    found = [("a", {0: ("0", "10"), 10: ("10", "20"), 20: ("20", "")}), ("b", {0: ("0", "10"), 10: ("11", "20"), 20: ("20", "")}), ("c", {0: ("0", "13"), 10: ("13", "20"), 20: ("", "")}), ("d", {0: ("0", "21"), 10: ("", ""), 20: ("21", "")}), ("e", {0: ("0", "10"), 10: ("10", "none"), 20: ("20", "")}), ("f", {0: ("0", ""), 10: ("", ""), 20: ("", "")})]
    table = dict(found)
    listed = spark.createDataFrame([(f, 25) for f, _ in found], "file string, size bigint")
    got = ranges.indexed(ranges.cut(listed, 10), lambda file, size, lo, hi: table[file][lo])
    by = {}
    for r in got.collect():
        by.setdefault(r["file"], []).append((r["start"], r["hi"]))
    whole = [("0", 25)]
    assert {f: sorted(x, key=lambda y: y[1]) for f, x in by.items()} == {"a": [("0", 10), ("10", 20), ("20", 25)], "b": whole, "c": whole, "d": [("0", 10), ("21", 25)], "e": whole, "f": [("0", 10)]}


def test_compressed_and_plain_reference(spark, tmp_path):
    fa = write(tmp_path / "x.fa.gz", gzip.compress(b">a\nAC\n>b\nGT\n"))
    assert [(r["id"], r["seq"]) for r in sequences.read_fasta(spark, fa).orderBy("record_idx").collect()] == [("a", "AC"), ("b", "GT")]
    head = "##fileformat=VCFv4.3\n##contig=<ID=c1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    p = write(tmp_path / "x.vcf.gz", gzip.compress((head + "c1\t7\t.\tA\tC\t.\t.\t.\n").encode()))
    assert [(r["pos"], r["_error"]) for r in vcf.read_vcf(spark, p).collect()] == [(7, None)]
    assert tuple(sequences.reference_text(spark, write(tmp_path / "r.txt", "AC-G\nT T\n"), "one").first()) == ("one", "ACGTT")
    assert [r[0] for r in spark.createDataFrame([("DEL_ME",), ("NONE",), ("DUP",)], "k string").select(vcf.sv_type_text(F.col("k"))).collect()] == ["<DEL:ME>", None, "<DUP>"]


def test_fasta_round_trip(spark, tmp_path):
    rows = [(f"s{i}", [], "ACGTN" * i) for i in range(1, 40)]
    sequences.write_fasta(spark.createDataFrame(rows, "id string, extra array<string>, seq string"), str(tmp_path / "out"))
    assert sorted((r["id"], r["seq"]) for r in sequences.read_fasta(spark, str(tmp_path / "out")).collect()) == sorted((a, c) for a, _, c in rows)
    assert sequences.single_sequence(spark, write(tmp_path / "y.fa", ">a\nA\n>b\nC\n"), "b").first()["seq"] == "C"


def test_fastq(spark, tmp_path):
    data = "@r1 x\nACG\nT\n+\n@II\nI\n@r2\nAC\n+r2\n+@\n"
    got = [(r["id"], r["seq"], r["qual"]) for r in sequences.read_fastq(spark, write(tmp_path / "x.fq", data)).orderBy("record_idx").collect()]
    assert got == [("r1 x", "ACGT", "@III"), ("r2", "AC", "+@")]
    with pytest.raises(ValueError):
        list(sequences.fastq_records(iter(["@a", "ACG", "+", "II"])))


def test_fastq_ranges(spark, tmp_path):
    """One file read by many tasks equals the file read by one; qualities start with @, records have several lines."""
    r, parts, want = random.Random(3), [], []
    for i in range(900):
        seq = "".join(r.choice("ACGTN") for _ in range(r.randrange(0, 90)))
        qual = "".join(r.choice("@+I#") for _ in seq)
        cut = r.randrange(len(seq) + 1)
        lines = lambda x, c=cut: [x] if c in (0, len(x)) else [x[:c], x[c:]]
        parts.append("\n".join([f"@read{i} x", *lines(seq), "+", *lines(qual)]) + "\n")
        want.append((i, f"read{i} x", seq, qual))
    data = "".join(parts)
    p = write(tmp_path / "x.fq", data)
    for size in (1 << 20, 3000, 701):
        got = sequences.read_fastq(spark, p, size)
        assert sorted(tuple(x)[1:] for x in got.collect()) == want, size
    gz = write(tmp_path / "y.fastq.gz", gzip.compress(data.encode()))
    assert sorted(tuple(x)[1:] for x in sequences.read_fastq(spark, gz, 500).collect()) == want
    sequences.write_fastq(spark.createDataFrame(want[:50], "i int, id string, seq string, qual string").orderBy("i").coalesce(1), str(tmp_path / "out"))
    back = sequences.read_fastq(spark, str(tmp_path / "out" / "part-*"))
    assert sorted((x["id"], x["seq"], x["qual"]) for x in back.collect()) == sorted(w[1:] for w in want[:50])
    assert sequences.read_fastq(spark, write(tmp_path / "none.fq", "")).count() == 0
    with pytest.raises(Exception, match="shorter"):
        sequences.read_fastq(spark, write(tmp_path / "bad.fq", "@a\nACGT\n+\nII\n")).collect()


def test_delimited_fields(spark):
    lines = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    get = lambda df: [tuple(r) for r in df.collect()]
    f = sequences.delimited_fields
    assert get(f(lines("1|x|2.5"), "a bigint, _skip1 string, d double", "|")) == [(1, 2.5)]
    assert get(f(lines("a,b;c"), "x string, y string, z string", [",", ";"])) == [("a", "b", "c")]
    assert get(f(lines("a\tT\tx,y", "b\tN"), "x char(1), y boolean, z array<string>", repeating=",", optional=1)) == [("a", True, ["x", "y"]), ("b", False, None)]
    assert get(f(lines("7 1 2 3"), "a int, b array<int>", " ", repeating=" ")) == [(7, [1, 2, 3])]
    bad = lambda v, schema, **k: f(lines(v), schema, mode="PERMISSIVE", **k).first()["_error"]
    assert tuple(bad("ab\tx", "a string, b bigint")) == (1, 4, "not bigint: x")
    assert bad("abc\td", "a char(1), b string")["position"] == 1 and bad("a", "a string, b string")["message"] == "the field is missing"
    assert bad("a\tb\tc", "a string, b string")["field"] == 2 and bad("a\tb", "a string, b string") is None
    assert bad("a\x01\tb", "a string, b string", printable=("a",))["field"] == 0
    with pytest.raises(Exception, match="field 1 at 3: not int: q"):
        f(lines("5\tq"), "a int, b int").collect()


def test_bed_and_delimited(spark, tmp_path):
    assert [tuple(r) for r in sequences.read_bed(spark, write(tmp_path / "x.bed", "chr1\t1\t5\tname\nchr2\t7\t9\n")).orderBy("begin").collect()] == [("chr1", 1, 5), ("chr2", 7, 9)]
    with pytest.raises(Exception, match="not a region"):
        sequences.read_bed(spark, write(tmp_path / "y.bed", "chr1\t1\n")).collect()
    got = sequences.read_delimited(spark, write(tmp_path / "t.tsv", "a\tC\tasdf\nb\tI\t123\n"), "c1 string, tag string", tag="tag", branches={"C": (2, "string"), "I": (2, "int")})
    assert sorted(tuple(r) for r in got.collect()) == [("a", "C", "asdf", None), ("b", "I", None, 123)]


SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:chr1\tLN:100
@SQ\tSN:chr2\tLN:50
q1\t99\tchr1\t7\t30\t8M2I4M\t=\t37\t39\tTTAGATAAAGGATA\t*\tNM:i:1\tZZ:Z:a b\tXF:f:0.5\tBA:B:c,1,-2\tHH:H:1AE3
q2\t0\t*\t0\t0\t*\t*\t0\t0\t*\t*
"""


def test_sam_round_trip(spark, tmp_path):
    p = write(tmp_path / "x.sam", SAM)
    df = sam.read_sam(spark, p)
    r = df.where("qname = 'q1'").first()
    assert r["pos0"] == 6 and r["rnext"] == "chr1" and r["cigar"][1]["op"] == "I" and r["tags"]["BA"]["bi"] == [1, -2] and bytes(r["tags"]["HH"]["h"]) == b"\x1a\xe3"
    assert sorted(x["value"] for x in sam.record_text(df).collect()) == sorted(SAM.splitlines()[3:])
    assert [r["name"] for r in sam.references(spark, sam.read_header(spark, p)).orderBy("rname_id").collect()] == ["chr1", "chr2"]
    both = df.select(F.struct("*").alias("a"), F.struct("*").alias("b"))
    assert all(r[0] for r in both.select(sam.same_record("a", "b")).collect())
    assert df.where(sam.is_primary()).count() == 2 and "NM" not in sam.erase_tags(df, ["NM"]).where("qname='q1'").first()["tags"]


def test_sam_modes(spark, tmp_path):
    bad = ["q3\tx\tchr1\t7\t30\t4M\t*\t0\t0\tACGT\t*", "q4\t0\tchr1\tp\t30\t4Q\t*\t0\t0\tACGT\t*", "q5\t0\tchr1\t7", "q6\t0\t*\t0\t0\t*\t*\t0\t0\t*\t*\tNM:i:1\tNM:i:2", "q7\t0\t*\t0\t0\t*\t*\t0\t0\t*\t*\tNM:i:x"]
    p = write(tmp_path / "bad.sam", SAM + "\n".join(bad) + "\n")
    got = {r["qname"]: r["_error"] for r in sam.read_sam(spark, p, "PERMISSIVE").collect()}
    assert got == {"q1": None, "q2": None, "q3": "FLAG is not a number of 16 bits", "q4": "POS is not a position; CIGAR is malformed", "q5": "too few columns; MAPQ is not a number of 8 bits; CIGAR is malformed; PNEXT is not a position; TLEN is not a number", "q6": "a tag repeats", "q7": "a tag is malformed"} | {"q5": got["q5"]}
    assert got["q5"].startswith("too few columns")
    assert sam.read_sam(spark, p, "DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="FLAG is not"):
        sam.read_sam(spark, p).collect()


def test_sam_headers_and_tags(spark, tmp_path):
    p = write(tmp_path / "x.sam", SAM)
    head = sam.read_header(spark, p)
    assert sam.header_text(head) == SAM.splitlines()[:3] and sam.sort_order(head) == ("coordinate", "none")
    assert [f["SN"] for k, f in sam.header_subset(head, ["SQ"], ["chr2"])] == ["chr2"]
    assert [f.get("SN") for _, f in sam.header_rename(head, "SQ", {"chr1": "one"})] == [None, "one", "chr2"]
    with pytest.raises(ValueError, match="repeat"):
        sam.header_rename(head, "SQ", {"chr1": "chr2"})
    with pytest.raises(ValueError, match="unknown"):
        sam.sort_order([("HD", {"SO": "x"})])
    df = sam.read_sam(spark, p)
    sam.write_sam(df, head, str(tmp_path / "out"), ["qname"])
    assert "".join(x.read_text() for x in sorted((tmp_path / "out").glob("part-*"))) == SAM
    lengths = {r["qname"]: (r["rname_id"], r["rname_length"]) for r in sam.with_reference(df, sam.references(spark, head)).collect()}
    assert lengths == {"q1": (0, 100), "q2": (None, None)}
    line = lambda d, q="q1", **k: [r["value"] for r in sam.record_text(d, **k).collect() if r["value"].startswith(q)][0].split("\t")[11:]
    assert line(df, sort_tags=True) == sorted(SAM.splitlines()[3].split("\t")[11:])
    assert line(sam.erase_tags_if(df, lambda k, t: t["type"] == "i")) == SAM.splitlines()[3].split("\t")[12:]
    assert line(sam.obtain_tag(df, "NM", "i", F.lit(9)))[0] == "NM:i:1" and line(sam.obtain_tag(df, "NM", "Z", F.lit("z")))[0] == "NM:Z:z"
    assert line(sam.obtain_tag(df, "QQ", "Z", F.lit("z")))[-1] == "QQ:Z:z" and line(sam.obtain_tag(df, "QQ", "i", F.lit(4)), "q2") == ["QQ:i:4"]
    pair = df.where("qname = 'q1'").select(F.struct("*").alias("a"))
    other = lambda c, v: pair.withColumn("b", F.col("a").withField(c, v)).select(sam.same_record("a", "b")).first()[0]
    assert other("flag", F.lit(99)) and not other("flag", F.lit(98)) and not other("seq", F.lit("A")) and not other("tags", F.map_filter("a.tags", lambda k, v: k != "NM"))
    assert [r[0] for r in df.orderBy("qname").select(sam.mapq_from_quality(F.col("mapq"))).collect()] == [-3, -33]


def bam_bytes(n):
    refs = b"".join(struct.pack("<i", len(x) + 1) + x + b"\0" + struct.pack("<i", 100) for x in (b"chr1", b"chr2"))
    head, rec = b"@HD\tVN:1.6\n", []
    out = b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<i", 2) + refs
    r = random.Random(4)
    for i in range(n):
        name, seq = f"read{i}".encode() + b"\0", [r.randrange(16) for _ in range(r.randrange(1, 60))]
        packed = bytes((seq[j] << 4) | (seq[j + 1] if j + 1 < len(seq) else 0) for j in range(0, len(seq), 2))
        qual = bytes([0xFF] * len(seq)) if i % 3 == 0 else bytes(r.randrange(40) for _ in seq)
        tags = b"NMC" + bytes([i % 200]) + b"ZZZhello\0" + b"BABs" + struct.pack("<ihh", 2, -5, i % 300) + b"HHH1AE3\0" + b"FFf" + struct.pack("<f", 0.25)
        body = struct.pack("<iiBBHHHiiii", i % 2, i, len(name), 7, 0, 1, 16, len(seq), -1, -1, 0) + name + struct.pack("<I", len(seq) << 4) + packed + qual + tags
        rec.append((f"read{i}", "chr1" if i % 2 == 0 else "chr2", i, "".join(sam.BASES[x] for x in seq), None if i % 3 == 0 else "".join(chr(q + 33) for q in qual), i % 200, [-5, i % 300]))
        out += struct.pack("<i", len(body)) + body
    return out, rec


def test_bam(spark, tmp_path):
    data, want = bam_bytes(300)
    p = write(tmp_path / "x.bam", sam.write_bgzf(data, block=700))  # records span blocks
    assert gzip.decompress((tmp_path / "x.bam").read_bytes()) == data
    rows = sam.read_bam(spark, p).orderBy("block", "i").collect()
    assert [(r["qname"], r["rname"], r["pos0"], r["seq"], r["qual"], r["tags"]["NM"]["i"], r["tags"]["BA"]["bi"]) for r in rows] == want
    assert rows[0]["tags"]["HH"]["h"] == b"\x1a\xe3" and rows[0]["tags"]["FF"]["f"] == 0.25 and rows[0]["tags"]["ZZ"]["z"] == "hello"


def test_bam_ranges(spark, tmp_path):
    """One file read by many tasks, records spanning blocks and ranges, equals the whole."""
    data, want = bam_bytes(3000)
    packed = sam.write_bgzf(data, block=1500)
    p = write(tmp_path / "x.bam", packed)
    for size in (len(packed) + 1, 20000, 3001):
        df = sam.read_bam(spark, p, size)
        rows = df.orderBy("block", "i").collect()
        assert [(r["qname"], r["rname"], r["pos0"], r["seq"], r["qual"], r["tags"]["NM"]["i"], r["tags"]["BA"]["bi"]) for r in rows] == want, size
    assert sam.read_bam(spark, p, 3001).rdd.getNumPartitions() > 10
    head, refs = sam.read_bam_header(p)
    assert head == [("HD", {"VN": "1.6"})] and refs == [("chr1", 100), ("chr2", 100)]
    with pytest.raises(Exception, match="checksum|inside|invalid"):
        sam.read_bam(spark, write(tmp_path / "cut.bam", packed[: len(packed) // 2])).collect()


def test_alloc_log(spark, tmp_path):
    word = lambda last, kind, data: struct.pack(">Q", last << 63 | kind << 56 | data)
    data = struct.pack(">QQ", 1, 2) + b"".join(struct.pack(">Q", len(x)) + x for x in (b"load", b"run"))
    data += word(0, 0, 1500) + word(0, 1, 4096) + word(1, 2, 1) + word(0, 0, 2999) + word(1, 1, 8)
    got = alloclog.read_log(spark, write(tmp_path / "x.log", data)).orderBy("at").collect()
    assert [(r["seconds"], r["event"], r["data"]) for r in got] == [(1, "allocated_amount", "4096"), (1, "marker", "run"), (2, "allocated_amount", "8")]


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(text.parse_command_arguments(F.lit('a "b c" "d""e"'))) == ["a", "b c", 'd"e']
    assert one(text.only_printable(F.lit("a b~"))) and not one(text.only_printable(F.lit("a\tb")))
    with pytest.raises(Exception, match="no power of two"):
        one(bits.gte_power_of_2(F.lit((1 << 62) + 1), strict=True))
    with pytest.raises(Exception, match="not a boolean"):
        one(text.parse_boolean(F.lit("x")))
    with pytest.raises(Exception, match="not a list of arguments from 3"):
        one(text.parse_command_arguments(F.lit('a "b')))
    assert [one(bits.from_bits(bits.reverse_bits(F.lit(0xED).cast("bigint"), g, 8))) for g in (1, 2, 4, 8)] == [0xB7, 0x7B, 0xDE, 0xED]
    assert [one(bits.gte_power_of_2(F.lit(x).cast("bigint"))) for x in (0, 1, 5, 8, 1 << 62, (1 << 62) + 1)] == [1, 1, 8, 8, 1 << 62, 0]
    assert one(text.parse_boolean(F.lit("Y"))) is True and bytes(one(text.hex_bytes(F.lit("0AFF")))) == b"\x0a\xff" and one(text.hex_bytes(F.lit("0a"))) is None
    assert one(text.cigar_text(text.cigar_operations(F.lit("3M2D")))) == "3M2D" and one(text.cigar_operations(F.lit("3M2"))) is None
