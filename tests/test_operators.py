"""Operators on tables worked by hand."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strandspark.functions import checks
from strandspark.functions import tuples as T
from strandspark.functions import vectors as V
from strandspark.operators import accumulators, alphabets, chains, ordered, pbwt, positions, sets
from strandspark.operators import matrices as M
from strandspark.plans import tools
from strandspark.sources import vcf
from strandspark.streaming import text
from strandspark.streaming import vcf as stream


def test_set_sizes(spark):
    one = lambda f, a, b: spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(f(F.col("a"), F.col("b"))).first()[0]
    r = random.Random(12)
    for _ in range(12):
        a, b = (sorted(r.sample(range(20), r.randrange(9))) for _ in range(2))
        assert one(sets.symmetric_difference_size, a, b) == len(set(a) ^ set(b)) and one(sets.intersection_size, a, b) == len(set(a) & set(b))
        assert one(sets.nonempty_intersection, a, b) == bool(set(a) & set(b))
    left, right = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([7, 7, 7, 9, 11], [7, 7, 11, 11, 40]))
    assert sets.multiset_intersection_size(left, right, "k").first()[0] == 3


def test_runs_and_merges(spark):
    seq = spark.createDataFrame([(0, i, v) for i, v in enumerate([7, 7, 3, 9, 9, 9, 9, 3, 3])], "g int, i int, v int")
    assert [(r["v"], r["n"]) for r in ordered.run_lengths(seq, ["g"], ["i"], "v").orderBy("run").collect()] == [(7, 2), (3, 1), (9, 4), (3, 2)]
    side = lambda v: spark.createDataFrame([(k, i) for i, k in enumerate(v)], "key int, idx int")
    keys = lambda df: [(r["key"], r["side"]) for r in df.collect()]
    assert keys(ordered.merge_projected(side([11, 12, 30]), side([11, 20, 31]), "key")) == [(11, 1), (11, 0), (12, 0), (20, 1), (30, 0), (31, 1)]
    assert keys(ordered.merge_projected(side([11, 25, 13]), side([2, 14, 18]), "key", stop_at=25)) == [(2, 1), (11, 0), (14, 1), (18, 1)]
    regions = spark.createDataFrame([("c", 10, 50), ("c", 50, 80), ("c", 70, 90), ("c", 200, 210)], "k string, begin bigint, end bigint")
    assert sorted((r["begin"], r["end"]) for r in ordered.merge_intervals(regions, ["k"], "begin", "end").collect()) == [(10, 50), (50, 90), (200, 210)]


def test_pearson(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.5), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 3.0, 1.0), ("d", None, 1.0)]
    got = {r["g"]: r["r"] for r in accumulators.pearson(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert abs(got["a"] - 0.9979487) < 1e-6 and math.isnan(got["b"]) and math.isnan(got["c"]) and got["d"] is None


def prefix_orders(seqs):
    """By column, rows in the order of reversed prefixes, and divergences."""
    out = []
    for c in range(len(seqs[0])):
        order = sorted(range(len(seqs)), key=lambda i: (seqs[i][: c + 1][::-1], i))
        divergence = [c + 1]
        for a, b in zip(order, order[1:]):
            same = 0
            while same <= c and seqs[a][c - same] == seqs[b][c - same]:
                same += 1
            divergence.append(c + 1 - same)
        out.append((order, divergence))
    return out


def regions(seqs, least, unknown):
    """Identity regions column by column."""
    out, before, last = [], {}, [0] * len(seqs)
    for c, (order, divergence) in enumerate(prefix_orders(seqs)):
        now, lead = {}, order[0]
        for i in order:
            if unknown and seqs[i][c] == unknown:
                last[i] = c + 1
        for i, d in list(zip(order, divergence))[1:]:
            if c + 1 - max(d, last[i]) >= least:
                now[lead, i] = c + 1 - max(d, last[i])
            elif c + 1 - d < least:
                lead = i
        out += [(c - 1, *k, n) for k, n in before.items() if k not in now]
        before = now
    return sorted(out + [(len(seqs[0]) - 1, *k, n) for k, n in before.items()])


def similar(rows, length, seed):
    r = random.Random(seed)
    base = [r.choice("ACGT") for _ in range(length)]
    seqs = ["".join(c if r.random() > 0.02 else r.choice("ACGTN") for c in base) for _ in range(rows - 1)]
    return [*seqs, seqs[0]]


@pytest.mark.parametrize("rows, length", [(6, 7), (50, 2000)])
def test_pbwt(spark, rows, length):
    """Ranks, divergences and identity regions, with and without an unknown character, against plain Python."""
    seqs = similar(rows, length, rows)
    df = spark.createDataFrame(list(enumerate(seqs)), "row_idx int, seq string")
    got = {(r["col"], r["row_idx"]): (r["rank"], r["divergence"]) for r in pbwt.ranked(df).collect()}
    assert got == {(c, i): (k, d) for c, (o, ds) in enumerate(prefix_orders(seqs)) for k, (i, d) in enumerate(zip(o, ds))}
    for unknown in ("", "N"):
        assert sorted(tuple(r) for r in pbwt.identity_regions(df, 5, unknown).collect()) == regions(seqs, 5, unknown)


def test_pbwt_edges(spark, tmp_path):
    with pytest.raises(Exception, match="equal length"):
        pbwt.ranked(spark.createDataFrame([(0, "AC"), (1, "A")], "row_idx int, seq string")).collect()
    assert pbwt.ranked(spark.createDataFrame([], "row_idx int, seq string")).count() == 0
    one = spark.createDataFrame([(5, "ACA")], "row_idx int, seq string")
    assert sorted(tuple(r) for r in pbwt.ranked(one).collect()) == [(0, 5, 0, 1), (1, 5, 0, 2), (2, 5, 0, 3)] and pbwt.identity_regions(one, 1).count() == 0
    copies = spark.createDataFrame([(0, "ACAC"), (1, "ACAT"), (2, "ACAC")], "row_idx int, seq string")
    assert sorted(tuple(r) for r in pbwt.substring_runs(copies, 4, 1).where("col = 3").collect()) == [(3, 0, 2, 0), (3, 1, 1, 1), (3, 2, 2, 0)]
    seqs = similar(9, 60, 4)
    (tmp_path / "a.fa").write_text("".join(f">s{i}\n{s[:30]}\n{s[30:]}\n" for i, s in enumerate(seqs)))
    for ignore, unknown in ((False, ""), (True, "N")):
        tools.write_identity_report(tools.msa_identity_regions(spark, str(tmp_path / "a.fa"), 4, ignore), str(tmp_path / f"out{ignore}"))
        lines = "".join(x.read_text() for x in sorted((tmp_path / f"out{ignore}").glob("part-*"))).splitlines()
        assert lines[0] == "Position\tMatched string\tMatching string\tMatch length"
        assert [tuple(map(int, x.split("\t"))) for x in lines[1:]] == regions(seqs, 4, unknown)


def test_alphabets(spark):
    df = spark.createDataFrame([("banana", 1), ("", 2), (None, 3), ("cab\u00e9", 4)], "t string, i int")
    assert sorted((r["ch"], r["n"]) for r in alphabets.characters(df, "t").collect()) == [("a", 4), ("b", 2), ("c", 1), ("n", 2), ("\u00e9", 1)]
    table = alphabets.alphabet(df, "t", terminator=True)
    assert sorted((r["ch"], r["comp"]) for r in table.collect()) == [("\0", 0), ("a", 1), ("b", 2), ("c", 3), ("n", 4), ("\u00e9", 5)]
    assert df.where("i = 4").select(F.transform(F.split("t", ""), lambda x: alphabets.char_to_comp(table)[x])).first()[0] == [3, 1, 2, 5]
    r = random.Random(1)
    rows = [(0 if i % 3 else r.randrange(9), i) for i in range(500)]
    got = alphabets.counting_sort(spark.createDataFrame(rows, "k int, i int"), "k", ["i"])
    assert {x["i"]: x["position"] for x in got.collect()} == {i: n for n, (_, i) in enumerate(sorted(rows), 1)}
    assert [tuple(x) for x in alphabets.key_counts(spark.createDataFrame([(2,), (4,), (2,)], "k int"), "k", 1, 4).orderBy("k").collect()] == [(1, 0), (2, 2), (3, 0), (4, 1)]


def test_matrices(spark):
    m = spark.createDataFrame([(r, c, 10 * r + c) for r in range(3) for c in range(4) if c != 2], "row int, col int, val int")
    cells = lambda df: sorted(tuple(r) for r in df.collect())
    assert cells(M.row(m, 1)) == [(0, 10), (1, 11), (3, 13)] and cells(M.column(m, 3)) == [(0, 3), (1, 13), (2, 23)]
    assert cells(M.part(m, (1, 3), (0, 2))) == [(0, 0, 10), (0, 1, 11), (1, 0, 20), (1, 1, 21)]
    assert M.same(M.transpose(M.transpose(m)), m) and not M.same(M.apply(m, lambda v: v + 1), m)
    assert M.same(M.swap_rows(M.swap_rows(m, 0, 2), 2, 0), m) and cells(M.resize(m, 1, 2)) == [(0, 0, 0), (0, 1, 1)]
    assert cells(M.fill_column(m, 2, 3, [7, 8]).where("col = 2")) == [(0, 2, 7), (1, 2, 8), (2, 2, 7)]
    with pytest.raises(Exception, match="not empty"):
        M.fill_column(m, 1, 3, [7]).collect()
    sparse = spark.createDataFrame([(2, "b"), (9, "d"), (5, "c")], "idx bigint, val string")
    assert cells(M.push_back(sparse, spark.createDataFrame([("x", 1), ("w", 0)], "val string, o int"), ["o"])) == [(2, "b"), (5, "c"), (9, "d"), (10, "w"), (11, "x")]
    assert cells(M.link(sparse).select("idx", F.coalesce("previous", F.lit(-1)), F.coalesce("next", F.lit(-1)))) == [(2, -1, 5), (5, 2, 9), (9, 5, -1)]
    assert cells(M.erase(sparse, sparse.where("idx = 5").select("idx"))) == [(2, "b"), (9, "d")] and cells(M.find(sparse, 9)) == [(9, "d")]


def test_vectors(spark):
    r = random.Random(2)
    for bits in (1, 4, 7, 16, 32):
        a, b = ([r.randrange(1 << bits) for _ in range(21)] for _ in range(2))
        df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>").select("a", "b", V.pack("a", bits).alias("p"), V.pack("b", bits).alias("q"))
        got = df.select(V.unpack("p", 21, bits).alias("u"), V.unpack(V.or_("p", "q"), 21, bits).alias("o"), V.unpack(V.and_("p", "q"), 21, bits).alias("n"), V.load("p", 20, bits).alias("l"), F.size("p").alias("w"), V.words_needed(21, bits).alias("x")).first()
        assert got["u"] == a and got["o"] == [x | y for x, y in zip(a, b)] and got["n"] == [x & y for x, y in zip(a, b)] and got["l"] == a[20] and got["w"] == got["x"]
    one = lambda c: spark.createDataFrame([([3, 1], [3, 2])], "a array<int>, b array<int>").select(c).first()[0]
    assert one(V.push_back("a", 9, 3)) == [3, 1, 9, 9, 9] and one(V.reverse("a")) == [1, 3] and one(V.resize("a", 4)) == [3, 1, 0, 0] and one(V.resize("a", 1)) == [3]
    assert one(V.less("a", "b")) and not one(V.equal("a", "b")) and one(V.equal("a", "a")) and one(V.bytes_needed(65, 1)) == 16 and one(V.or_("a", F.array(F.lit(1)))) is None


def test_tuples_and_checks(spark):
    one = lambda c: spark.createDataFrame([([4, 2, 4, 7], [1, 2, 3])], "a array<int>, b array<int>").select(c).first()[0]
    assert [tuple(x) for x in one(T.group_by("a", lambda x: x % 2))] == [(0, [4, 2, 4]), (1, [7])]
    assert one(T.pairwise_apply("a", "b", lambda x, y: x * y)) == [4, 4, 12] and one(T.erase("a", lambda x: x == 4)) == [2, 7] and one(T.find("a", 9)) == -1
    assert one(T.head("a")) == 4 and one(T.last("b")) == 3 and one(T.slice_("a", 1, 3)) == [2, 4] and one(T.element_or("b", 5, -1)) == -1 and one(T.unique("a")) == [4, 2, 7]
    assert one(checks.compared(F.col("a")[0], ">", F.col("b")[0])) == 4 and one(checks.compared(F.col("a")[0], "<", F.col("b")[0], debug=False)) == 4
    with pytest.raises(Exception, match="expected 4 < 1"):
        one(checks.compared(F.col("a")[0], "<", F.col("b")[0]))
    with pytest.raises(Exception, match="no such"):
        one(checks.checked(F.col("a")[0], F.lit(None).cast("boolean"), "no such"))
    n = lambda x: F.lit(x).cast("bigint")
    assert one(checks.mixed(n(-1), "<", n(-1))) and not one(checks.mixed(n(-1), "==", n(-1))) and one(checks.mixed(n(5), "==", n(5))) and one(checks.mixed(n(-2), "<", n(-1), True, True))
    assert re.fullmatch(r"\[\d\d:\d\d:\d\d\] go", one(checks.log_time(F.lit("go"))))


def test_chain(spark):
    t = spark.createDataFrame([("a", "a", 0.25), ("a", "b", 0.75), ("b", "a", 1.0)], "src string, dst string, p double")
    w = spark.createDataFrame([(1, [0.1, 0.3, 0.9]), (2, [])], "walk int, probabilities array<double>")
    assert {r["walk"]: r["states"] for r in chains.walk(t, w, "a").collect()} == {1: ["a", "a", "b", "a"], 2: ["a"]}


def test_chain_generators(spark):
    counts = spark.createDataFrame([("a", "a", 1), ("a", "b", 3), ("b", "a", 5)], "src string, dst string, n int")
    t = chains.normalised(counts)
    assert {(r["src"], r["dst"]): (r["upto"], r["total"]) for r in chains.cumulative(t).collect()} == {("a", "a"): (0.25, 1.0), ("a", "b"): (1.0, 1.0), ("b", "a"): (1.0, 1.0)}
    walks = chains.generated(spark, 300, 12)
    p = {r["walk"]: r["probabilities"] for r in walks.collect()}
    assert p == {r["walk"]: r["probabilities"] for r in chains.generated(spark, 300, 12).collect()} and abs(sum(map(sum, p.values())) / 3600 - 0.5) < 0.03
    want = {}
    for w, ps in p.items():
        path = ["a"]
        for x in ps:
            path.append("a" if path[-1] == "b" or x < 0.25 else "b")
        want[w] = path
    assert {r["walk"]: r["states"] for r in chains.simulate(t, "a", 300, 12).collect()} == want
    assert {r["walk"]: r["states"] for r in chains.walk_by_steps(t, walks, "a").collect()} == want


def test_running_sum(spark):
    rows = [(i * 7919 % 1000, i, i % 13) for i in range(1000)]
    got = {r["i"]: r["s"] for r in positions.running_sum(spark.createDataFrame(rows, "k int, i int, v int"), ["k", "i"], "v", "s").collect()}
    total, want = 0, {}
    for _, i, v in sorted(rows):
        total += v
        want[i] = total
    assert got == want


def test_large_groups(spark):
    """What ranges that carry state give is what one task gives, with a group that holds most rows and nulls."""
    r = random.Random(7)
    rows = [("a" if r.random() < 0.8 else r.choice("bc"), i, r.choice([None, 1, 2, 2, 2, 3]), b := r.randrange(4000), b + r.randrange(1, 9)) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, i int, v int, b int, e int")
    for f in (
        lambda x: ordered.run_lengths(df, ["g"], ["i"], "v", large_groups=x),
        lambda x: ordered.run_numbers(df, ["g"], ["i"], "v", large_groups=x),
        lambda x: ordered.unsorted_rows(df, ["g"], ["i"], "v", large_groups=x),
        lambda x: ordered.merge_intervals(df, ["g"], "b", "e", large_groups=x),
        lambda x: ordered.distances(df, ["g"], ["i"], "b", large_groups=x),
        lambda x: ordered.fold_adjacent(df.withColumns({"o": F.col("b"), "p": F.col("e")}), ["g"], ["o", "p", "i"], "b", "e", [], large_groups=x),
    ):
        one, many = (sorted(map(str, map(tuple, f(x).select(*sorted(f(x).columns)).collect()))) for x in (False, True))
        assert one == many and one


def test_text_streams(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.sam").write_text(f"@HD\tVN:1.6\nq{i}\t0\tc1\t5\t9\t2M\t*\t0\t0\tAC\tII\nr{i}\t256\tc1\t5\t9\t2M\t*\t0\t0\tAC\tII\nbad\tx\n")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.fa").write_text(">a x\nAC\nGT\n>b\nA\n")
    run = lambda df, mode, name: df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
    run(text.mapped_counts(text.read_sam_stream(spark, str(tmp_path / "*.sam"))), "complete", "mapped")
    assert [tuple(r) for r in spark.sql("SELECT * FROM mapped").collect()] == [("c1", 6, 3)]
    run(text.read_fasta_stream(spark, str(tmp_path / "f")), "append", "sequences")
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM sequences").collect()) == [("a", ["x"], "ACGT"), ("b", [], "A")]


def test_stream(spark, tmp_path):
    head = "##fileformat=VCFv4.3\n##contig=<ID=c1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    for i in range(3):
        (tmp_path / f"{i}.vcf").write_text(head + f"c1\t{i + 1}\t.\tA\tC\t.\t.\t.\nc1\t9\t.\tAC\tA\t.\t.\t.\nc2\tx\t.\tA\tC\t.\t.\t.\n")
    q = stream.running_counts(stream.read_stream(spark, str(tmp_path), vcf.parse_header(head.splitlines()))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.sql("SELECT * FROM counts").collect()] == [("c1", 6, 3)]


def test_positions_spread_over_ranges(spark):
    """Numbers and neighbours match a sort in Python when one group has most rows, with ties in the key and a null group."""
    rows = [(("a", "b", None)[0 if i % 5 else i % 3], i * 7919 % 1000 // 10, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, k int, i int")
    number = {r["i"]: r["n"] for r in positions.numbered(df, [F.desc("k"), "i"], "n").collect()}
    assert number == {i: n for n, (_, i) in enumerate(sorted((-k, i) for _, k, i in rows), 1)}
    grouped = {r["i"]: r["n"] for r in positions.numbered(df, ["k", "i"], "n", ["g"]).collect()}
    before = {r["i"]: r["p"] for r in positions.with_previous(df, ["g"], ["k", "i"], "k", "p").collect()}
    assert len(grouped) == len(before) == len(rows)
    for g in ("a", "b", None):
        order = sorted((k, i) for h, k, i in rows if h == g)
        for n, (_, i) in enumerate(order):
            assert grouped[i] == n + 1 and before[i] == (order[n - 1][0] if n else None)
    assert positions.numbered(df.limit(0), ["i"], "n").count() == 0


def test_fold_adjacent_cuts_groups(spark):
    rows = [("c", 0, 5), ("c", 3, 9), ("c", 5, 7), ("c", 9, 12), ("c", 20, 21), ("c", 21, 30), ("c", 22, 23), ("d", 1, 2)]
    df = spark.createDataFrame(rows, "g string, b int, e int").withColumn("o", F.col("b"))
    got = ordered.fold_adjacent(df, ["g"], ["o"], "b", "e", [])
    assert sorted((r["g"], r["chain"], r["b"], r["e"]) for r in got.collect()) == [
        ("c", 1, 0, 5), ("c", 1, 5, 7), ("c", 2, 9, 12), ("c", 3, 20, 21), ("c", 3, 21, 30), ("d", 1, 1, 2),
    ]
