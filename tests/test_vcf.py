"""VCF source, sink and tools on hand-worked records."""

import pytest
from pyspark.sql import functions as F

from strandspark.plans import tools
from strandspark.plans import variants as V
from strandspark.sources import vcf

TEXT = """##fileformat=VCFv4.3
##INFO=<ID=FLAG,Number=0,Type=Flag,Description="f">
##INFO=<ID=I1,Number=1,Type=Integer,Description="i, with comma">
##INFO=<ID=FA,Number=A,Type=Float,Description="a">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=FI,Number=R,Type=Integer,Description="r">
##contig=<ID=chr1,length=40>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
chr1\t3\ta;b\tC\tG\t10\tPASS\tFLAG;I1=5;FA=0.5\tGT:FI\t1/1:1,2\t0|1:3,.
chr1\t5\t.\tA\tC,GT\t.\t.\t.\tGT\t0|2\t.|0
chr1\t9\tx\tT\t<DEL>\t1.5\t.\tI1=.\tFI:GT\t1:1/0\t2:0/0
"""
REF = [("chr1", "AACGATTTTACGT")]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("vcf") / "a.vcf"
    p.write_text(TEXT)
    h = vcf.read_header(spark, str(p))
    return h, vcf.read_vcf(spark, str(p), h, lineno=True), str(p)


def test_header(records):
    h = records[0]
    assert h.samples == ["S1", "S2"] and h.of("INFO")["I1"]["Description"] == "i, with comma" and h.of("INFO")["DP"]["reserved"]
    assert vcf.parse_header(h.text()).entries == h.entries
    with pytest.raises(ValueError):
        vcf.parse_header(["##nothing"])


def test_records(records):
    h, df, _ = records
    rows = df.withColumn("typed", vcf.info_struct(h)).withColumn("fi", F.transform("samples", lambda s: vcf.sample_field(h, s, "FI"))).orderBy("pos").collect()
    assert [r["lineno"] for r in rows] == [9, 10, 11] and all(r["_error"] is None for r in rows)
    a = rows[0]
    assert (a["chrom"], a["pos"], a["ids"], a["ref"], a["qual"], a["filters"]) == ("chr1", 3, ["a", "b"], "C", 10.0, [])
    assert a["typed"]["FLAG"] is True and a["typed"]["I1"] == 5 and a["typed"]["FA"] == [0.5] and a["fi"] == [[1, 2], [3, None]]
    assert [(g["alt"], g["phased"]) for g in a["samples"][1]["gt"]] == [(0, False), (1, True)]
    assert [g["alt"] for g in rows[1]["samples"][1]["gt"]] == [None, 0] and rows[1]["filters"] is None and rows[1]["ids"] is None
    assert rows[2]["alts"][0]["sv_type"] == "DEL" and rows[2]["typed"]["I1"] is None


def test_round_trip(records):
    h, df, _ = records
    lines = [r["value"] for r in vcf.record_text(df.orderBy("pos"), True).collect()]
    assert lines == TEXT.splitlines()[8:]


def test_errors(spark, tmp_path):
    p = tmp_path / "bad.vcf"
    p.write_text(TEXT + "chr1\tx\t.\tC\tG\t.\t.\tNOPE=1\tGT\t3/0\t0/0\n")
    assert [r["_error"] for r in vcf.read_vcf(spark, str(p)).where("_error IS NOT NULL").collect()] == ["POS is not a position; INFO key is not declared; allele above the number of ALTs"]
    assert vcf.read_vcf(spark, str(p), mode="DROPMALFORMED").count() == 3
    with pytest.raises(Exception, match="POS is not a position"):
        vcf.read_vcf(spark, str(p), mode="FAILFAST").collect()


def test_repeated_keys_and_columns(spark, tmp_path):
    p = tmp_path / "r.vcf"
    p.write_text(TEXT + "chr1\t11\t.\tC\tG\t.\t.\tI1=3;I1=4\tGT:FI:FI\t0/0:1:2\t0/0:3\n")
    r = vcf.read_vcf(spark, str(p)).where("pos = 11").first()
    assert r["_error"] == "INFO key repeats; FORMAT key repeats" and r["info"] == {"I1": "3"} and r["info_keys"] == ["I1"] and r["samples"][0]["fields"]["FI"] == "1"
    upto = vcf.read_vcf(spark, str(p), upto="ALT").orderBy("pos").collect()
    assert [(x["pos"], x["ref"], x["qual"], x["info"], x["samples"], x["_error"]) for x in upto][0] == (3, "C", None, None, None, None) and len(upto) == 4
    (tmp_path / "two").mkdir()
    for n in "ab":
        (tmp_path / "two" / f"{n}.vcf").write_text(TEXT)
    both = vcf.read_vcf(spark, str(tmp_path / "two"), vcf.parse_header(TEXT.splitlines()[:8]), lineno=True)
    assert sorted(x["lineno"] for x in both.collect()) == [9, 9, 10, 10, 11, 11]
    assert [x["pos"] for x, _ in zip(vcf.iterate(both.orderBy("pos")), range(2))] == [3, 3]


def test_cat_tool(spark, records, tmp_path):
    """From files to a file, which is read again."""
    h, _, path = records
    (tmp_path / "s.txt").write_text("S1\n\n")
    (tmp_path / "r.bed").write_text("chr1\t2\t6\n")
    tools.vcfcat(spark, [path], str(tmp_path / "out"), include_file=str(tmp_path / "s.txt"), bed=str(tmp_path / "r.bed"), missing_id_prefix="m", omit_info=True, formats=["GT"])
    text = "".join(x.read_text() for x in sorted((tmp_path / "out").glob("part-*")))
    assert vcf.parse_header([x for x in text.splitlines() if x.startswith("#")]).entries == h.entries
    assert [x for x in text.splitlines() if x[0] != "#"] == ["chr1\t3\ta;b\tC\tG\t10\tPASS\t.\tGT\t1/1", "chr1\t5\tm1\tA\tGT\t.\t.\t.\tGT\t0|1"]
    tools.vcfcat(spark, [path, path], str(tmp_path / "all"), exclude=["S2"])
    (tmp_path / "all.vcf").write_text("".join(x.read_text() for x in sorted((tmp_path / "all").glob("part-*"))))
    again = vcf.read_vcf(spark, str(tmp_path / "all.vcf"))
    assert [r["pos"] for r in again.orderBy("pos").collect()] == [3, 3, 5, 5, 9, 9] and vcf.read_header(spark, str(tmp_path / "all.vcf")).samples == ["S1"]
    other = tmp_path / "o.vcf"
    other.write_text(TEXT.replace("I1,Number=1", "I1,Number=2"))
    with pytest.raises(ValueError, match="INFO I1"):
        tools.vcfcat(spark, [path, str(other)], str(tmp_path / "no"))


def test_counts(spark, records, tmp_path):
    h, df, _ = records
    bed = spark.createDataFrame([("chr1", 2, 3), ("chr1", 8, 10)], "chrom string, begin bigint, end bigint")
    more = df.unionByName(df.where("pos = 3").withColumn("chrom", F.lit("chr9")))
    assert tuple(V.region_counts(more, bed).first()) == (4, 1, 1)
    ref = spark.createDataFrame(REF, "id string, seq string")
    assert sorted(tuple(r) for r in V.reference_counts(more, ref, "chr1").collect()) == [("chr1", True, 3, 3, 0), ("chr9", False, 1, 0, 0)]
    assert sorted(tuple(r) for r in V.phase_set_counts(df, "chr1").collect()) == [("S1", 0, 3), ("S2", 0, 3)]
    assert {r["pos"]: r["n"] for r in V.private_counts(df, ["S1"]).collect()} == {3: 0, 5: 1, 9: 1} and V.private_total(df, ["S1"]).first()["n"] == 2
    assert {(r["record"], r["row"]["si"], r["row"]["copy"]): r["allele"] for r in V.genotype_cells(df, ["pos"]).collect()} == {(0, 0, 0): 1, (0, 0, 1): 1, (0, 1, 0): 0, (0, 1, 1): 1, (1, 0, 0): 0, (1, 0, 1): 2, (1, 1, 0): None, (1, 1, 1): 0, (2, 0, 0): 1, (2, 0, 1): 0, (2, 1, 0): 0, (2, 1, 1): 0}
    assert V.write_image(df, ["pos"], str(tmp_path / "g.tif")) == (3, 4)
    data = (tmp_path / "g.tif").read_bytes()
    assert data[:4] == b"II*\0" and data[8:20] == bytes([2, 1, 2, 2, 3, 1, 1, 0, 1, 2, 1, 1])
    same = df.unionByName(df).withColumn("ids", F.lit(None).cast("array<string>"))
    assert sorted(r["ids"][0] for r in V.fill_missing_ids(same, "m", ["chrom", "pos"]).collect()) == [f"m{i}" for i in range(1, 7)]


def test_projection_and_ends(spark, records):
    h, df, _ = records
    assert [(r["info_keys"], sorted(r["info"] or {})) for r in V.project_info(df, ["I1"]).orderBy("pos").collect()][0] == (["I1"], ["I1"])
    assert V.project_format(df, ["FI"]).orderBy("pos").first()["format"] == ["FI"] and V.project_info(df, []).where("size(info) > 0").count() == 0
    ended = df.withColumn("info", F.when(F.col("pos") == 3, F.create_map(F.lit("END"), F.lit("30"))).otherwise(F.col("info")))
    assert [r[0] for r in ended.orderBy("pos").select(vcf.variant_end(ended)).collect()] == [30, 5, 9]
    meta = vcf.meta_table(spark, h).collect()
    assert [r["id"] for r in meta][:2] == ["FLAG", "I1"] and meta[1]["number"] == "1" and [r["name"] for r in vcf.sample_table(spark, h).collect()] == ["S1", "S2"]


def test_filters(records):
    _, df, _ = records
    assert [r["pos"] for r in V.snps_only(df).orderBy("pos").collect()] == [3, 5]
    assert [r["pos"] for r in V.zygosity(df, 2).collect()] == [3]
    pruned = V.prune_alts(V.select_samples(df, include=["S1"])).orderBy("pos").collect()
    assert [a["alt"] for a in pruned[1]["alts"]] == ["GT"] and [g["alt"] for g in pruned[1]["samples"][0]["gt"]] == [0, 1]
    assert [r["pos"] for r in V.prune_alts(V.select_samples(df, exclude=["S1"])).collect()] == [3]
    assert [r["ids"] for r in V.fill_missing_ids(df, "m", ["pos"]).orderBy("pos").collect()] == [["a", "b"], ["m1"], ["x"]]
    assert [r["pos"] for r in V.drop_with_info(df, ["I1"]).orderBy("pos").collect()] == [5, 9]
    assert V.cat(df).count() == 3 and V.cat(df, chrom="chr2").count() == 0


def test_statistics(spark, records):
    _, df, _ = records
    assert [r["distance"] for r in V.distances(df, "chr1").orderBy("pos").collect()] == [2, 4]
    assert {(r["sample"], r["copy"]): r["n"] for r in V.counts_per_copy(df, "chr1").collect()} == {("S1", 0): 2, ("S1", 1): 2, ("S2", 0): 0, ("S2", 1): 1}
    assert sorted((r["pos"], r["alt"]) for r in V.private_variants(df, ["S1"]).collect()) == [(5, 2), (9, 1)]
    assert V.genotype_cells(df, ["pos"]).count() == 12
    bed = spark.createDataFrame([("chr1", 2, 3), ("chr1", 8, 10)], "chrom string, begin bigint, end bigint")
    assert sorted(r["pos"] for r in V.in_bed(df, bed).collect()) == [3, 9]


def test_reference(spark, records):
    _, df, _ = records
    ref = spark.createDataFrame(REF, "id string, seq string")
    assert V.check_reference(df, ref).collect() == []
    wrong = df.withColumn("ref", F.lit("G"))
    assert sorted((r["pos"], r["expected"]) for r in V.check_reference(wrong, ref).collect()) == [(3, "C"), (5, "A"), (9, "T")]
    d = {r["pos"]: (r["ref"], [a["alt"] for a in r["alts"]]) for r in V.convert_deletions(df, ref).collect()}
    assert d[8] == ("TT", ["T"]) and d[3] == ("C", ["G"])


def test_concatenate(spark, tmp_path):
    p = tmp_path / "h.vcf"
    head = TEXT.splitlines()[:7] + ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1"]
    body = [f"chr1\t{p}\t.\t{r}\t{a}\t.\t.\t.\tGT\t{g}" for p, r, a, g in [(3, "CG", "T", 1), (4, "G", "A", 1), (5, "A", "C", 1), (6, "T", "G", 0), (7, "T", "A", 1)]]
    p.write_text("\n".join(head + body) + "\n")
    got = V.concatenate(vcf.read_vcf(spark, str(p)), spark.createDataFrame(REF, "id string, seq string"))
    assert sorted(tuple(r) for r in got.collect()) == [("chr1", 3, "CGA", "TC"), ("chr1", 7, "T", "A")]


def test_merging(spark, records):
    h, df, path = records
    twice = df.unionByName(df)
    got = {(r["pos"], r["alt"]): [list(s["gt"]) for s in r["samples"]] for r in V.merge_records(twice).collect()}
    assert got[(5, "GT")] == [[0, 1], [0, 0]] and got[(3, "G")] == [[1, 1], [0, 1]]
    other = vcf.parse_header(h.text())
    merged = V.merge_files([df, df], [h, other]).collect()
    assert [r["pos"] for r in merged] == [3, 3, 5, 5, 9, 9] and [s["name"] for s in merged[0]["samples"]] == ["SAMPLE1.1", "SAMPLE1.2", "SAMPLE2.1", "SAMPLE2.2"]
    made = V.merge_files([df, df], [h, other], generate_samples=True, ploidy=2).collect()
    assert [[g["alt"] for g in s["gt"]] for s in made[1]["samples"]] == [[0, 0], [1, 1]]
    other.entries[1]["Number"] = "2"
    with pytest.raises(ValueError, match="INFO"):
        V.merge_files([df, df], [h, other])
