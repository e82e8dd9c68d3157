"""Relational twins of the library's operators over the driver's tables, each with SQL for DuckDB.

Orders are by unique columns (o_orderkey, p_partkey, event_id ...), since (l_orderkey, l_linenumber) is not unique.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandspark.functions import bits, checks, text, tuples, vectors
from strandspark.operators import accumulators as acc
from strandspark.operators import alphabets, chains, matrices, ordered, pbwt, positions, sets
from strandspark.plans import variants
from strandspark.sources import alloclog, sam, sequences, vcf

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def twin(sql: str):
    """Register a function of the tables under its name, with its oracle."""

    def wrap(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        _SQL[f.__name__] = sql
        return f

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


c = lambda name: F.col(name)

# --- records and what they are made of ---------------------------------------------------------------------------------

#: An order is a record and its line items are the record's samples, each with two copies.
_ROWS = """(SELECT l_orderkey AS pos, 'chr' || (l_orderkey % 3) AS chrom, 'S' || l_linenumber AS name, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
  CASE WHEN CAST(l_quantity AS BIGINT) % 7 <> 0 THEN CAST(l_quantity AS BIGINT) % 3 END AS a0, l_suppkey % 4 AS a1, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey % 90 AS INT) END AS ps,
  CASE l_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AC' ELSE 'G' END AS ref FROM lineitem)"""
_POS = f"(SELECT DISTINCT pos, chrom, ref FROM {_ROWS})"
_ALTS = ["T", "GA", "<DEL>"]
_ALT = "CASE a WHEN 1 THEN 'T' WHEN 2 THEN 'GA' ELSE '<DEL>' END"
#: Bases of the reference; it is shorter than some positions.
_REF_BASES = 12_000


def _records(t):
    """Line items as variant records, as the VCF reader gives them."""
    q = c("l_quantity").cast("bigint")
    gt = F.array(F.struct(F.when(q % 7 != 0, q % 3).cast("smallint").alias("alt"), F.lit(False).alias("phased")), F.struct((c("l_suppkey") % 4).cast("smallint").alias("alt"), (c("l_partkey") % 2 == 0).alias("phased")))
    fields = F.when(c("l_partkey") % 5 != 0, F.create_map(F.lit("PS"), (c("l_partkey") % 90).cast("string"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", q.alias("q"), F.concat(F.lit("S"), "l_linenumber").alias("name"), gt.alias("gt"))
    rows = t.lineitem.select("l_orderkey", item.alias("s"), fields.alias("fields"))
    listed = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("s", F.map_entries("fields").alias("f")))).alias("x"))
    samples = F.transform("x", lambda e: F.struct(e["s"]["name"].alias("name"), F.map_from_entries(e["f"]).alias("fields"), e["s"]["gt"].alias("gt")))
    pos = c("l_orderkey")
    alts = F.array(*[F.struct(F.lit(a).alias("alt"), F.lit("DEL" if a[0] == "<" else "NONE").alias("sv_type")) for a in _ALTS])
    dp = F.create_map(F.lit("DP"), (pos % 50).cast("string"))
    info = F.when(pos % 6 == 0, F.map_concat(dp, F.create_map(F.lit("END"), (pos + 10).cast("string")))).otherwise(dp)
    return listed.select(
        F.concat(F.lit("chr"), pos % 3).alias("chrom"), pos.alias("pos"), F.when(pos % 4 != 0, F.array(F.concat(F.lit("rs"), pos))).alias("ids"), F.when(pos % 3 == 0, "A").when(pos % 3 == 1, "AC").otherwise("G").alias("ref"),
        alts.alias("alts"), F.lit(None).cast("double").alias("qual"), F.expr("cast(array() as array<string>)").alias("filters"), F.map_keys(info).alias("info_keys"), info.alias("info"),
        F.array(F.lit("GT"), F.lit("PS")).alias("format"), samples.alias("samples"),
    )


def _reference(t):
    return t.spark.range(3).select(F.concat(F.lit("chr"), "id").alias("id"), F.repeat(F.lit("ACG"), _REF_BASES // 3).alias("seq"))


# --- filters and projections ------------------------------------------------------------------------------------------


@twin("SELECT user_id, event_id, event_id - lag(event_id) OVER w AS distance FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY distance IS NOT NULL")
def variant_distances(t):
    return ordered.distances(t.events, ["user_id"], ["event_id"], "event_id").select("user_id", "event_id", "distance")


@twin("SELECT user_id, count(*) AS n FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE value < p GROUP BY user_id")
def sortedness_check(t):
    return ordered.unsorted_rows(t.events, ["user_id"], ["event_id"], "value").groupBy("user_id").agg(F.count("*").alias("n"))


@twin(f"SELECT name AS sample, copy, count(*) FILTER (a > 0) AS n FROM (SELECT name, chrom, 0 AS copy, a0 AS a FROM {_ROWS} UNION ALL SELECT name, chrom, 1, a1 FROM {_ROWS}) WHERE chrom = 'chr1' GROUP BY ALL")
def count_per_copy(t):
    return variants.counts_per_copy(_records(t), "chr1").select("sample", c("copy").cast("int").alias("copy"), "n")


@twin(f"SELECT pos, name AS sample, ps FROM {_ROWS} WHERE chrom = 'chr1'")
def phase_sets(t):
    return variants.phase_sets(_records(t), "chr1")


@twin(f"SELECT name AS sample, count(ps) AS set, count(*) FILTER (ps IS NULL) AS unset FROM {_ROWS} WHERE chrom = 'chr1' GROUP BY name")
def phase_set_counts(t):
    return variants.phase_set_counts(_records(t), "chr1")


@twin(f"SELECT pos, ref, count(*) AS n FROM {_ROWS} WHERE chrom = 'chr1' GROUP BY ALL")
def chrom_filter(t):
    return variants.cat(_records(t), chrom="chr1").select("pos", "ref", F.size("samples").cast("bigint").alias("n"))


@twin(f"SELECT pos, ref, 'T' AS alts FROM {_POS} WHERE length(ref) = 1")
def snp_filter(t):
    return variants.snps_only(_records(t)).select("pos", "ref", F.array_join("alts.alt", ",").alias("alts"))


@twin(f"SELECT DISTINCT pos FROM {_ROWS} WHERE CASE WHEN a0 > 0 THEN 1 ELSE 0 END + CASE WHEN a1 > 0 THEN 1 ELSE 0 END = 2")
def zygosity_exact_k(t):
    return variants.zygosity(_records(t), 2).select("pos")


@twin(f"SELECT pos, name, count(*) AS n FROM {_ROWS} WHERE name IN ('S1', 'S3') GROUP BY ALL")
def sample_include(t):
    kept = variants.select_samples(_records(t), include=["S1", "S3"])
    return kept.select("pos", F.explode("samples.name").alias("name")).groupBy("pos", "name").agg(F.count("*").alias("n"))


@twin(f"SELECT pos, name, count(*) AS n FROM {_ROWS} WHERE name NOT IN ('S1', 'S3') GROUP BY ALL")
def sample_exclude(t):
    kept = variants.select_samples(_records(t), exclude=["S1", "S3"])
    return kept.select("pos", F.explode("samples.name").alias("name")).groupBy("pos", "name").agg(F.count("*").alias("n"))


@twin(f"""WITH r AS (SELECT pos, a0, a1 FROM {_ROWS} WHERE name IN ('S1', 'S2')), x AS (SELECT pos, a0 AS a FROM r UNION ALL SELECT pos, a1 FROM r),
k AS (SELECT pos, a, row_number() OVER (PARTITION BY pos ORDER BY a) AS number FROM (SELECT DISTINCT pos, a FROM x WHERE a > 0))
SELECT pos, string_agg(alt, ',' ORDER BY a) AS alts, CAST(sum(n * number) AS BIGINT) AS total FROM (SELECT pos, a, any_value(number) AS number, count(*) AS n, any_value({_ALT}) AS alt FROM x JOIN k USING (pos, a) GROUP BY pos, a) GROUP BY pos""")
def alt_prune_renumber(t):
    pruned = variants.prune_alts(variants.select_samples(_records(t), include=["S1", "S2"]))
    alleles = F.flatten(F.transform("samples", lambda s: F.transform(s["gt"], lambda g: g["alt"])))
    return pruned.select("pos", F.array_join("alts.alt", ",").alias("alts"), F.aggregate(alleles, F.lit(0).cast("bigint"), lambda n, a: n + F.coalesce(a, F.lit(0))).alias("total"))


@twin(f"SELECT pos, CASE WHEN pos % 6 = 0 THEN 'END' ELSE '' END AS keys, CASE WHEN pos % 6 = 0 THEN CAST(pos + 10 AS VARCHAR) END AS value, CASE WHEN pos % 6 = 0 THEN 1 ELSE 0 END AS n FROM {_POS}")
def info_project(t):
    return variants.project_info(_records(t), ["END", "XX"]).select("pos", F.array_join("info_keys", ",").alias("keys"), F.get(F.map_values("info"), F.lit(0)).alias("value"), F.size("info").alias("n"))


@twin(f"SELECT pos, 'PS' AS keys FROM {_POS}")
def format_project(t):
    return variants.project_format(_records(t), ["PS", "XX"]).select("pos", F.array_join("format", ",").alias("keys"))


@twin(f"SELECT pos, 0 AS n FROM {_POS}")
def info_omit(t):
    return variants.cat(_records(t), omit_info=True).select("pos", (F.size("info") + F.size("info_keys")).alias("n"))


@twin(f"SELECT pos, CASE WHEN pos % 4 = 0 THEN 'id' || row_number() OVER (PARTITION BY pos % 4 = 0 ORDER BY chrom, pos) ELSE 'rs' || pos END AS id FROM {_POS}")
def fill_missing_id(t):
    return variants.fill_missing_ids(_records(t), "id", ["chrom", "pos"]).select("pos", c("ids")[0].alias("id"))


@twin(f"SELECT pos FROM {_POS} WHERE pos % 6 <> 0")
def drop_if_info_set(t):
    return variants.drop_with_info(_records(t), ["END", "XX"]).select("pos")


@twin(f"SELECT chrom, chrom <> 'chr0' AS checked, count(*) AS records, count(*) FILTER (chrom <> 'chr0' AND ok) AS matches, count(*) FILTER (chrom <> 'chr0' AND NOT ok) AS mismatches FROM (SELECT chrom, pos % 3 = 1 AND pos < {_REF_BASES} AS ok FROM {_POS}) WHERE chrom <> 'chr0' GROUP BY ALL")
def ref_check(t):
    return variants.reference_counts(_records(t).where("chrom <> 'chr0'"), _reference(t))


@twin(f"SELECT chrom, pos, ref, CASE WHEN pos <= {_REF_BASES} THEN 'C' END AS expected FROM {_POS} WHERE chrom = 'chr2'")
def ref_mismatches(t):
    return variants.check_reference(_records(t), _reference(t), "chr2")


@twin(f"""SELECT CASE WHEN old = 1 THEN 1 ELSE old - 1 END AS pos, CASE WHEN old = 1 THEN ref || base ELSE base || ref END AS ref, CASE WHEN base IS NULL THEN '' WHEN old = 1 THEN 'T' || base || ',GA' || base || ',' || base ELSE base || 'T,' || base || 'GA,' || base END AS alts
FROM (SELECT pos AS old, ref, CASE WHEN pos = 1 THEN 'G' WHEN pos - 1 <= {_REF_BASES} THEN substr('ACG', CAST((pos - 2) % 3 AS INT) + 1, 1) END AS base FROM {_POS} WHERE pos > 0)""")
def deletion_rewrite(t):
    return variants.convert_deletions(_records(t).where("pos > 0"), _reference(t)).select("pos", "ref", F.array_join("alts.alt", ",").alias("alts"))


@twin(f"SELECT pos, CASE WHEN pos % 6 = 0 THEN pos + 10 ELSE pos - 1 + length(ref) END AS end_pos FROM {_POS}")
def end_pos(t):
    df = _records(t)
    return df.select("pos", vcf.variant_end(df).alias("end_pos"))


@twin("SELECT l_orderkey, l_partkey, (l_partkey & 2304) = 0 AS is_primary, l_linenumber - 33 AS mapq FROM lineitem")
def flag_mask(t):
    rows = t.lineitem.withColumn("flag", c("l_partkey"))
    return rows.select("l_orderkey", "l_partkey", sam.is_primary().alias("is_primary"), sam.mapq_from_quality(c("l_linenumber")).alias("mapq"))


@twin("SELECT c_custkey, a < b AS lt, a = b AS eq, a <= b AS lte FROM (SELECT c_custkey, CAST(c_nationkey - 12 AS HUGEINT) AS a, CAST(c_custkey % 20 - 9 AS HUGEINT) + CASE WHEN c_custkey % 20 < 9 THEN CAST('18446744073709551616' AS HUGEINT) ELSE 0 END AS b FROM customer)")
def mixed_sign_compare(t):
    a, b = (c("c_nationkey") - 12).cast("bigint"), (c("c_custkey") % 20 - 9).cast("bigint")
    return t.customer.select("c_custkey", checks.mixed(a, "<", b).alias("lt"), checks.mixed(a, "==", b).alias("eq"), checks.mixed(a, "<=", b).alias("lte"))


# --- intervals and joins ----------------------------------------------------------------------------------------------

_REGIONS = "SELECT event_type AS chrom, user_id * 20 AS b, user_id * 20 + 15 + CAST(floor(value) AS BIGINT) % 20 AS e FROM events"
_MERGED = f"""SELECT chrom, min(b) AS "begin", max(e) AS "end" FROM (
  SELECT *, sum(CASE WHEN b < reach THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({_REGIONS}))) GROUP BY chrom, island"""


def _regions(t):
    end = c("user_id") * 20 + 15 + F.pmod(F.floor("value"), F.lit(20))
    return t.events.select(c("event_type").alias("chrom"), (c("user_id") * 20).alias("begin"), end.alias("end"))


@twin(_MERGED)
def interval_merge(t):
    return ordered.merge_intervals(_regions(t), ["chrom"], "begin", "end")


@twin(f'SELECT event_id, event_type AS chrom FROM events v WHERE EXISTS (SELECT 1 FROM ({_MERGED}) r WHERE r.chrom = v.event_type AND r."begin" <= v.event_id % 20000 AND v.event_id % 20000 < r."end")')
def region_semijoin(t):
    rows = t.events.select("event_id", c("event_type").alias("chrom"))
    return ordered.in_regions(rows, ordered.merge_intervals(_regions(t), ["chrom"], "begin", "end"), "chrom", c("event_id") % 20000)


@twin("SELECT 'type' AS kind, p_type AS id, 2 AS files FROM (SELECT p_type, count(DISTINCT p_size) AS n FROM (SELECT p_type, count(*) AS p_size, 0 AS f FROM part WHERE p_partkey % 2 = 0 GROUP BY p_type UNION ALL SELECT p_type, count(*), 1 FROM part WHERE p_partkey % 2 = 1 GROUP BY p_type) GROUP BY p_type HAVING count(*) = 2 AND n = 2)")
def metadata_mismatch(t):
    file = c("p_partkey") % 2
    meta = t.part.groupBy(c("p_type").alias("id"), file.alias("file")).agg(F.count("*").alias("number")).withColumn("kind", F.lit("type")).withColumn("type", F.lit("Integer"))
    return sets.mismatched_metadata(meta).select("kind", "id", c("files").cast("int").alias("files"))


@twin("SELECT o_orderkey, f, row_number() OVER (ORDER BY o_orderdate, f, o_orderkey) AS position FROM (SELECT *, 0 AS f FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT *, 1 AS f FROM orders WHERE o_orderstatus <> 'F')")
def kway_merge(t):
    first, second = (t.orders.where(x).select("o_orderkey", "o_orderdate") for x in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"))
    merged = ordered.kway_merge([first, second], ["o_orderdate"], "f")
    return ordered.stable_sort(merged, c("o_orderdate"), ["f", "o_orderkey"]).select("o_orderkey", "f", "position")


def _two_sides(t):
    e = t.events.select(F.floor("value").alias("key"), c("event_id").alias("idx"), "event_type")
    return (e.where(f"event_type {op} 'click'").select("key", "idx") for op in ("=", "<>"))


_SIDES = "SELECT CAST(floor(value) AS BIGINT) AS key, event_id AS idx, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS side FROM events"


@twin(f"SELECT key, idx, side, row_number() OVER (ORDER BY key, side DESC, idx) AS position FROM ({_SIDES})")
def merge_projected_ties_right(t):
    left, right = _two_sides(t)
    return positions.numbered(ordered.merge_projected(left, right, "key"), ["key", F.desc("side"), "idx"], "position")


@twin(f"SELECT key, idx, side FROM (SELECT *, max(CASE WHEN key >= 300 THEN 1 ELSE 0 END) OVER (PARTITION BY side ORDER BY idx) AS stop FROM ({_SIDES})) WHERE stop = 0")
def merge_projected_stop(t):
    return ordered.merge_projected(*_two_sides(t), "key", stop_at=300)


@twin("SELECT event_id, user_id FROM events WHERE event_type <> 'click' AND event_id < (SELECT coalesce(min(event_id), 1 << 62) FROM events WHERE value > 60 AND event_id > 500)")
def validator_stop(t):
    kept = ordered.validated(t.events, ["event_id"], c("event_type") == "click", (c("value") > 60) & (c("event_id") > 500))
    return kept.select("event_id", "user_id")


@twin("WITH m AS (SELECT event_id // 50 AS place, user_id, event_type FROM events) SELECT DISTINCT place, user_id, event_type FROM m WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.place = m.place + 1 AND x.user_id = m.user_id AND x.event_type = m.event_type)")
def match_difference(t):
    m = t.events.select(F.floor(c("event_id") / 50).alias("place"), "user_id", "event_type").distinct()
    return sets.matches_that_end(m, "place", ["user_id", "event_type"])


@twin("SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k")
def set_union_sides(t):
    o = t.orders.select(c("o_custkey").alias("key"), "o_orderstatus")
    return sets.sides(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "key")


@twin("SELECT l_partkey, count(*) AS n FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag <> 'R') GROUP BY l_partkey")
def private_alleles(t):
    inside, outside = t.lineitem.where("l_returnflag = 'R'"), t.lineitem.where("l_returnflag <> 'R'")
    return sets.difference(inside.select("l_partkey", "l_suppkey"), outside, ["l_partkey", "l_suppkey"]).groupBy("l_partkey").agg(F.count("*").alias("n"))


@twin(f"""SELECT record, allele, CASE allele WHEN 0 THEN '#ffffff' WHEN 1 THEN '#1f3a93' WHEN 2 THEN '#c0392b' WHEN 3 THEN '#27ae60' ELSE '#808080' END AS rgb, count(*) AS n FROM (
  SELECT dense_rank() OVER (ORDER BY pos) - 1 AS record, unnest([a0, a1]) AS allele FROM {_ROWS}) GROUP BY ALL""")
def genotype_matrix(t):
    cells = variants.genotype_cells(_records(t), ["pos"])
    return cells.groupBy("record", c("allele").cast("bigint").alias("allele"), "rgb").agg(F.count("*").alias("n"))


@twin(f"""WITH x AS (SELECT pos, name IN ('S1', 'S2') AS inside, unnest([a0, a1]) AS a FROM {_ROWS})
SELECT pos, a AS alt FROM x WHERE a > 0 GROUP BY pos, a HAVING bool_and(inside)""")
def private_variants(t):
    return variants.private_variants(_records(t), ["S1", "S2"]).select("pos", c("alt").cast("bigint").alias("alt"))


@twin(f"""WITH x AS (SELECT pos, name IN ('S1', 'S2') AS inside, unnest([a0, a1]) AS a FROM {_ROWS})
SELECT count(*) AS n FROM (SELECT pos, a FROM x WHERE a > 0 GROUP BY pos, a HAVING bool_and(inside))""")
def private_total(t):
    return variants.private_total(_records(t), ["S1", "S2"])


# --- statistics -------------------------------------------------------------------------------------------------------


def _agg(name: str, column, sql_fn: str) -> None:
    def f(t):
        return acc.summary(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity").select("l_returnflag", "l_linestatus", column().alias("v"))

    f.__name__ = name
    twin(f"SELECT l_returnflag, l_linestatus, {sql_fn} AS v FROM lineitem GROUP BY ALL")(f)


_agg("acc_sum", lambda: F.round("sum", 2), "round(sum(l_quantity), 2)")
_agg("acc_mean", lambda: F.round("mean", 6), "round(avg(l_quantity), 6)")
_agg("acc_min", lambda: c("min"), "min(l_quantity)")
_agg("acc_max", lambda: c("max"), "max(l_quantity)")


@twin("SELECT l_returnflag, min(s) AS min_sum FROM (SELECT l_returnflag, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS s FROM lineitem GROUP BY ALL) GROUP BY ALL")
def acc_min_sum(t):
    rows = t.lineitem.withColumn("q", c("l_quantity").cast("bigint"))
    return acc.across_parts(rows, ["l_returnflag"], "l_suppkey", "q", "min")


@twin("SELECT l_returnflag, max(s) AS max_sum FROM (SELECT l_returnflag, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS s FROM lineitem GROUP BY ALL) GROUP BY ALL")
def acc_max_sum(t):
    rows = t.lineitem.withColumn("q", c("l_quantity").cast("bigint"))
    return acc.across_parts(rows, ["l_returnflag"], "l_suppkey", "q", "max")


_R = "SELECT l_returnflag, round(greatest(-1, least(1, covar_pop(l_quantity, l_extendedprice) / sqrt(var_pop(l_quantity) * var_pop(l_extendedprice)))), 6) AS r FROM lineitem GROUP BY l_returnflag"


@twin(_R)
def pearson(t):
    return acc.pearson(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", F.round("r", 6).alias("r"))


@twin(_R)
def pearson_pairwise(t):
    states = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(*acc.moments("l_quantity", "l_extendedprice"))
    return acc.merged_moments(states, ["l_returnflag"]).select("l_returnflag", F.round(acc.correlation(), 6).alias("r"))


_PAIR = "SELECT l_orderkey, coalesce(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'N'), []) AS a, coalesce(list(DISTINCT l_linenumber) FILTER (l_returnflag <> 'N'), []) AS b FROM lineitem GROUP BY l_orderkey"


def _pair(t):
    n = c("l_returnflag") == "N"
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.when(n, c("l_linenumber"))).alias("a"), F.collect_set(F.when(~n, c("l_linenumber"))).alias("b"))


@twin(f"SELECT l_orderkey, len(a) + len(b) - 2 * len(list_intersect(a, b)) AS n FROM ({_PAIR})")
def symdiff_size(t):
    return _pair(t).select("l_orderkey", sets.symmetric_difference_size(c("a"), c("b")).cast("bigint").alias("n"))


@twin(f"SELECT l_orderkey, len(list_intersect(a, b)) AS n FROM ({_PAIR})")
def intersection_size(t):
    return _pair(t).select("l_orderkey", sets.intersection_size(c("a"), c("b")).cast("bigint").alias("n"))


@twin(f"SELECT l_orderkey, len(list_intersect(a, b)) > 0 AS meets FROM ({_PAIR})")
def nonempty_intersection(t):
    return _pair(t).select("l_orderkey", sets.nonempty_intersection(c("a"), c("b")).alias("meets"))


_RUNS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events"


@twin(f"SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM ({_RUNS}) GROUP BY user_id, event_type, g")
def run_lengths(t):
    runs = ordered.run_numbers(t.events, ["user_id"], ["event_id"], "event_type")
    return runs.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).drop("run")


@twin("SELECT p_size, count(*) AS n FROM part GROUP BY p_size")
def count_items(t):
    return acc.count_items(t.part, "p_size")


@twin("SELECT min(p_size) AS lo, max(p_size) AS hi FROM part")
def identifier_min_max(t):
    return acc.key_range(t.part, "p_size")


@twin("SELECT event_type, arg_min(event_id, (floor(value), event_id)) AS argmin, arg_max(event_id, (floor(value), -event_id)) AS argmax FROM events GROUP BY event_type")
def argmin_argmax(t):
    return acc.first_extremes(t.events.withColumn("v", F.floor("value")), ["event_type"], "v", "event_id")


@twin("SELECT user_id, CAST(bit_or(CAST(1 AS BIGINT) << CAST(event_id % 60 AS INT)) AS BIGINT) AS mask FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY floor(value) DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def argmax_mask(t):
    rows = t.events.select("user_id", F.floor("value").alias("v"), (c("event_id") % 60).alias("i"))
    return acc.argmax_mask(rows, ["user_id"], "v", "i")


@twin("SELECT o_orderkey, least(o_orderkey, o_custkey * 10) AS lo, greatest(o_orderkey, o_custkey * 10) AS hi FROM orders")
def least_greatest(t):
    return t.orders.select("o_orderkey", F.least("o_orderkey", c("o_custkey") * 10).alias("lo"), F.greatest("o_orderkey", c("o_custkey") * 10).alias("hi"))


@twin("""WITH r AS (SELECT o_orderkey // 8 AS pos, o_custkey % 2 + 1 AS ai, o_orderkey % 3 AS a0, o_custkey % 3 AS a1, o_custkey % 4 AS b0, o_orderkey % 4 AS b1 FROM orders),
g AS (SELECT pos, alt, unnest([1, 2]) AS k, a0, a1, b0, b1 FROM r, (SELECT unnest(['C', 'T']) AS alt) WHERE alt = 'C'),
m AS (SELECT pos, k, max(CAST(a0 = k AS INT)) AS a0, max(CAST(a1 = k AS INT)) AS a1, max(least(CAST(b0 = k AS INT), CAST(b1 = k AS INT))) AS b0, max(greatest(CAST(b0 = k AS INT), CAST(b1 = k AS INT))) AS b1 FROM g GROUP BY pos, k)
SELECT pos, CASE k WHEN 1 THEN 'C' ELSE 'T' END AS alt, 'A:' || a0 || '|' || a1 || ',B:' || b0 || '/' || b1 AS gts FROM m""")
def merge_genotypes(t):
    """Eight orders are records of one place; sample A is phased, B is not."""
    allele = lambda x, phased: F.struct(x.cast("smallint").alias("alt"), F.lit(phased).alias("phased"))
    sample = lambda name, x, y, phased: F.struct(F.lit(name).alias("name"), F.array(allele(x, False), allele(y, phased)).alias("gt"))
    samples = F.array(sample("A", c("o_orderkey") % 3, c("o_custkey") % 3, True), sample("B", c("o_custkey") % 4, c("o_orderkey") % 4, False))
    alts = F.array(*[F.struct(F.lit(x).alias("alt")) for x in "CT"])
    merged = variants.merge_records(t.orders.select(F.lit("chr1").alias("chrom"), F.floor(c("o_orderkey") / 8).alias("pos"), F.lit("A").alias("ref"), alts.alias("alts"), samples.alias("samples")))
    text_ = F.array_join(F.transform("samples", lambda s: F.concat(s["name"], F.lit(":"), s["gt"][0].cast("string"), F.when(s["phased"], "|").otherwise("/"), s["gt"][1].cast("string"))), ",")
    return merged.select("pos", "alt", text_.alias("gts"))


@twin("SELECT 'nation-' || n_nationkey AS id, sum(n) AS size FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) GROUP BY 1 UNION ALL SELECT 'region-' || n_regionkey, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'world', count(*) FROM customer".replace("sum(n)", "CAST(sum(n) AS BIGINT)"))
def rollup_tree(t):
    nations = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("size")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    leaves = nations.select(F.concat(F.lit("nation-"), "n_nationkey").alias("id"), F.concat(F.lit("region-"), "n_regionkey").alias("parent"), "size")
    regions = leaves.select(c("parent").alias("id"), F.lit("world").alias("parent"), F.lit(0).cast("bigint").alias("size")).distinct()
    world = t.spark.range(1).select(F.lit("world").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("size"))
    return acc.rollup_sizes(leaves.union(regions).union(world), 3)


# --- positional Burrows-Wheeler -----------------------------------------------------------------------------------------

_SEQ = "(SELECT p_partkey AS row_idx, lpad(bin(p_size), 6, '0') AS seq FROM part)"
_COLS = f"(SELECT row_idx, col, reverse(substr(seq, 1, CAST(col AS INT) + 1)) AS suffix FROM {_SEQ}, (SELECT unnest(generate_series(0, 5)) AS col))"
_RANKED = f"(SELECT col, row_idx, suffix, row_number() OVER w - 1 AS rank, lag(suffix) OVER w AS last FROM {_COLS} WINDOW w AS (PARTITION BY col ORDER BY suffix, row_idx))"
_AGREE = "len(list_filter(generate_series(1, col + 1), lambda i: substr(suffix, CAST(i AS INT) * 0 + 1, CAST(i AS INT)) = substr(last, 1, CAST(i AS INT))))"
_DIV = f"(SELECT col, row_idx, rank, CASE WHEN last IS NULL THEN col + 1 ELSE col + 1 - {_AGREE} END AS divergence FROM {_RANKED})"


def _seq(t):
    return t.part.select(c("p_partkey").alias("row_idx"), F.lpad(F.bin("p_size"), 6, "0").alias("seq"))


@twin(f"SELECT CAST(col AS INT) AS col, row_idx, rank FROM {_RANKED}")
def pbwt_rank(t):
    return pbwt.ranked(_seq(t)).select("col", "row_idx", "rank")


@twin(f"SELECT CAST(col AS INT) AS col, row_idx, CAST(divergence AS BIGINT) AS divergence FROM {_DIV}")
def pbwt_divergence(t):
    return pbwt.ranked(_seq(t)).select("col", "row_idx", "divergence")


@twin(f"SELECT CAST(col AS INT) AS col, CAST(divergence AS BIGINT) AS divergence, count(*) AS n FROM {_DIV} GROUP BY ALL")
def divergence_hist(t):
    return pbwt.divergence_counts(pbwt.ranked(_seq(t)))


@twin(f"SELECT CAST(col AS INT) AS col, count(*) FILTER (divergence > 2) AS n FROM {_DIV} GROUP BY ALL")
def unique_substring_count(t):
    return pbwt.unique_substring_count(pbwt.ranked(_seq(t)), 2)


_RUNSUB = f"SELECT CAST(col AS INT) AS col, substr(seq, 3, CAST(col AS INT) - 1) AS s, row_idx FROM {_SEQ}, (SELECT unnest(generate_series(2, 5)) AS col)"


@twin(f"SELECT col, row_idx, count(*) OVER w AS copies, min(row_idx) OVER w AS first_row FROM ({_RUNSUB}) WINDOW w AS (PARTITION BY col, s)")
def unique_substring_runs(t):
    return pbwt.substring_runs(_seq(t), 6, 2)


@twin(f"SELECT col, copies, first_row FROM (SELECT col, s, count(*) AS copies, min(row_idx) AS first_row FROM ({_RUNSUB}) GROUP BY col, s)")
def unique_substring_copies(t):
    return pbwt.substring_copies(_seq(t), 6, 2)


#: Some sequences hold an N.
_SEQ_N = "(SELECT p_partkey AS row_idx, CASE WHEN p_partkey % 5 = 0 THEN substr(s, 1, CAST(p_partkey % 6 AS INT)) || 'N' || substr(s, CAST(p_partkey % 6 AS INT) + 2) ELSE s END AS seq FROM (SELECT p_partkey, lpad(bin(p_size), 6, '0') AS s FROM part))"


def _seq_n(t):
    s = F.lpad(F.bin("p_size"), 6, "0")
    return t.part.select(c("p_partkey").alias("row_idx"), F.when(c("p_partkey") % 5 == 0, F.overlay(s, F.lit("N"), (c("p_partkey") % 6 + 1).cast("int"), F.lit(1))).otherwise(s).alias("seq"))


def _identity_sql(unknown: bool) -> str:
    last = "CASE WHEN contains(suffix, 'N') THEN col + 2 - instr(suffix, 'N') ELSE 0 END" if unknown else "0"
    cols = _COLS.replace(_SEQ, _SEQ_N)
    ranked = f"(SELECT col, row_idx, suffix, row_number() OVER w - 1 AS rank, lag(suffix) OVER w AS last FROM {cols} WINDOW w AS (PARTITION BY col ORDER BY suffix, row_idx))"
    return f"""WITH d AS (SELECT col, row_idx, rank, CASE WHEN last IS NULL THEN col + 1 ELSE col + 1 - {_AGREE} END AS divergence, {last} AS n FROM {ranked}),
h AS (SELECT *, rank = 0 OR col + 1 - divergence < 3 AS head, col + 1 - greatest(divergence, n) AS size FROM d),
m AS (SELECT col, row_idx, size, last_value(CASE WHEN head THEN row_idx END IGNORE NULLS) OVER (PARTITION BY col ORDER BY rank ROWS UNBOUNDED PRECEDING) AS leader, head FROM h),
r AS (SELECT col, row_idx, leader, size FROM m WHERE NOT head AND size >= 3)
SELECT CAST(col AS INT) AS position, leader, row_idx, CAST(size AS INT) AS length FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.col = r.col + 1 AND x.row_idx = r.row_idx AND x.leader = r.leader)"""


@twin(_identity_sql(False))
def msa_identity(t):
    return pbwt.identity_regions(_seq_n(t), 3)


@twin(_identity_sql(True))
def msa_identity_ignore_n(t):
    return pbwt.identity_regions(_seq_n(t), 3, "N")


# --- sorts, partitions, sets --------------------------------------------------------------------------------------------


@twin("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS position FROM part")
def radix_sort(t):
    return ordered.stable_sort(t.part, c("p_size"), ["p_partkey"]).select("p_partkey", "position")


@twin("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS position FROM part")
def radix_sort_desc(t):
    return ordered.stable_sort(t.part, F.desc("p_size"), ["p_partkey"]).select("p_partkey", "position")


@twin("SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) + (SELECT count(*) FROM part b WHERE b.p_size < a.p_size) AS position FROM part a")
def counting_sort(t):
    return alphabets.counting_sort(t.part.select("p_partkey", "p_size"), "p_size", ["p_partkey"]).select("p_partkey", "position")


@twin("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END, c_custkey) AS position FROM customer")
def stable_partition(t):
    return ordered.stable_partition(t.customer, c("c_acctbal") > 0, ["c_custkey"]).select("c_custkey", "position")


_AT = "SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000"


@twin(f"SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey IN ({_AT}) THEN 1 ELSE 0 END, c_custkey) AS position FROM customer")
def partition_at_indices(t):
    at = t.orders.where("o_totalprice > 450000").select(c("o_custkey").alias("c_custkey")).distinct().withColumn("_at", F.lit(1))
    return ordered.stable_partition(t.customer.join(at, "c_custkey", "left"), c("_at").isNull(), ["c_custkey"]).select("c_custkey", "position")


@twin(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN ({_AT})")
def remove_at_indices(t):
    at = t.orders.where("o_totalprice > 450000").select(c("o_custkey").alias("c_custkey")).distinct()
    return ordered.remove_at(t.customer.select("c_custkey"), "c_custkey", at)


@twin("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_difference(t):
    return sets.difference(t.customer.select(c("c_custkey").alias("k")), t.orders.where("o_totalprice > 400000").select(c("o_custkey").alias("k")), ["k"])


@twin("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return sets.union(t.customer.select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k")), ["k"])


@twin("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rank FROM events")
def tuple_rank(t):
    return ordered.rank_before(t.events, ["event_type"], ["event_id"]).select("event_id", "rank")


@twin("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS position FROM part")
def byte_order_sort(t):
    return t.part.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")).alias("position"))


@twin("SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS comp FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''")
def alphabet_ranks(t):
    return alphabets.alphabet(t.documents, "text").select("ch", c("comp").cast("bigint").alias("comp"))


@twin("""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b, event_id) AS rn FROM (SELECT user_id, event_id, event_id // 20 * 10 AS b, event_id // 20 * 10 + 10 * (1 + CAST(floor(value) AS BIGINT) % 2) AS e FROM events)),
f(user_id, rn, kept, last_end, chain) AS (SELECT user_id, rn, true, e, CAST(1 AS BIGINT) FROM s WHERE rn = 1
  UNION ALL SELECT s.user_id, s.rn, s.b >= f.last_end, CASE WHEN s.b >= f.last_end THEN s.e ELSE f.last_end END, f.chain + CASE WHEN s.b > f.last_end THEN 1 ELSE 0 END FROM f JOIN s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
SELECT user_id, chain, min(b) AS "begin", max(e) AS "end", count(*) AS n FROM f JOIN s USING (user_id, rn) WHERE kept GROUP BY user_id, chain""")
def concat_adjacent(t):
    b = F.floor(c("event_id") / 20) * 10
    rows = t.events.select("user_id", "event_id", b.alias("begin"), (b + 10 * (1 + F.floor("value") % 2)).alias("end"))
    folded = ordered.fold_adjacent(rows.withColumn("b", c("begin")), ["user_id"], ["b", "event_id"], "begin", "end", [])
    return folded.groupBy("user_id", "chain").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("n"))


# --- typed fields -------------------------------------------------------------------------------------------------------


@twin("SELECT event_id, CAST(string_split(x, '|')[1] AS BIGINT) AS a, string_split(x, '|')[2] AS b, CAST(string_split(x, '|')[3] AS DOUBLE) AS d FROM (SELECT event_id, user_id || '|' || event_type || '|' || CAST(floor(value) AS BIGINT) AS x FROM events)")
def typed_fields(t):
    lines = t.events.select("event_id", F.concat_ws("|", "user_id", "event_type", F.floor("value")).alias("value"))
    return sequences.delimited_fields(lines, "a bigint, b string, d double", "|", keep=("event_id",))


@twin("SELECT l_orderkey, l_returnflag, CASE WHEN l_returnflag IN ('T', 'Y') THEN true WHEN l_returnflag IN ('F', 'N') THEN false END AS flag FROM lineitem")
def bool_field(t):
    return t.lineitem.select("l_orderkey", "l_returnflag", text.parse_boolean(c("l_returnflag"), strict=False).alias("flag"))


@twin("SELECT event_id, event_type AS tag, CASE WHEN event_type = 'click' THEN user_id END AS click_value, CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) END AS view_value FROM events")
def conditional_field(t):
    lines = t.events.select("event_id", F.concat_ws("|", "event_type", "user_id").alias("value"))
    return sequences.delimited_fields(lines, "tag string", "|", keep=("event_id",), tag="tag", branches={"click": (1, "bigint"), "view": (1, "string")})


@twin("SELECT p_partkey, string_split(x, ' ')[1] AS first, CASE WHEN len(string_split(x, ' ')) >= 2 THEN string_split(x, ' ')[2] END AS second FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || ' ' || p_size END AS x FROM part)")
def optional_field(t):
    lines = t.part.select("p_partkey", F.when(c("p_size") % 2 == 0, c("p_brand")).otherwise(F.concat_ws(" ", "p_brand", "p_size")).alias("value"))
    return sequences.delimited_fields(lines, "first string, second string", " ", keep=("p_partkey",), optional=1)


@twin("SELECT p_partkey, p_brand AS brand, array_to_string(string_split(p_type, ' '), ',') AS parts, len(string_split(p_type, ' ')) AS n FROM part")
def repeating_field(t):
    lines = t.part.select("p_partkey", F.concat_ws(";", "p_brand", "p_type").alias("value"))
    got = sequences.delimited_fields(lines, "brand string, parts array<string>", ";", keep=("p_partkey",), repeating=" ")
    return got.select("p_partkey", "brand", F.array_join("parts", ",").alias("parts"), F.size("parts").cast("bigint").alias("n"))


@twin("SELECT event_id, 1 AS field, CAST(length(event_type) + 2 AS INT) AS position FROM events WHERE event_type <> 'click'")
def field_errors(t):
    text_ = F.concat_ws("|", "event_type", F.when(c("event_type") == "click", c("user_id").cast("string")).otherwise(F.lit("x")))
    got = sequences.delimited_fields(t.events.select("event_id", text_.alias("value")), "a string, b bigint", "|", keep=("event_id",), mode="PERMISSIVE")
    return got.where("_error IS NOT NULL").select("event_id", "_error.field", "_error.position")


# --- bits and text ------------------------------------------------------------------------------------------------------


def _bit(name: str, column, sql: str) -> None:
    def f(t):
        return t.orders.select("o_orderkey", column().alias("v"))

    f.__name__ = name
    twin(f"SELECT o_orderkey, {sql} AS v FROM orders")(f)


_bit("popcount", lambda: bits.count_bits_set("o_orderkey").cast("int"), "CAST(bit_count(o_orderkey) AS INT)")
_bit("trailing_zeros", lambda: bits.trailing_zeros("o_orderkey"), "CAST(instr(reverse(bin(o_orderkey)), '1') AS INT)")
_bit("leading_zeros", lambda: bits.leading_zeros("o_orderkey"), "CAST(CASE WHEN o_orderkey = 0 THEN 64 ELSE 64 - length(bin(o_orderkey)) END AS INT)")
_bit("highest_bit", lambda: bits.highest_bit_set("o_orderkey"), "CAST(CASE WHEN o_orderkey = 0 THEN 0 ELSE length(bin(o_orderkey)) END AS INT)")
_bit("is_pow2", lambda: bits.is_power_of_2("o_orderkey"), "bit_count(o_orderkey) = 1")
_bit("gte_pow2", lambda: bits.gte_power_of_2("o_orderkey"), "CASE WHEN o_orderkey <= 1 THEN CAST(1 AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST(length(bin(o_orderkey - 1)) AS INT) END")
_bit("reverse_bits", lambda: bits.reverse_bits("o_orderkey"), "reverse(lpad(bin(o_orderkey), 64, '0'))")
_bit("bit_pattern", lambda: bits.fill_bit_pattern("o_orderkey", 8), "repeat(lpad(bin(o_orderkey & 255), 8, '0'), 8)")


@twin("SELECT doc_id, length(text) AS n FROM documents")
def utf8_length(t):
    return t.documents.select("doc_id", F.char_length("text").cast("bigint").alias("n"))


@twin("SELECT p_partkey, TRY_CAST(substr(p_brand, length(p_brand), 1) AS BIGINT) AS digit, TRY_CAST(CASE WHEN p_name SIMILAR TO '[0-9]+' THEN p_name END AS BIGINT) AS whole FROM part")
def parse_integer(t):
    return t.part.select("p_partkey", text.parse_integer(F.substring("p_brand", -1, 1)).alias("digit"), text.parse_integer(c("p_name")).alias("whole"))


@twin("SELECT event_id, (w >> 63) & 1 = 1 AS last, CAST((w >> 56) & 127 AS INT) AS type, w & ((CAST(1 AS BIGINT) << 56) - 1) AS data FROM (SELECT event_id, ((event_id % 4) << 56) | user_id AS w FROM events)")
def alloc_log_decode(t):
    w = F.call_function("shiftleft", c("event_id") % 4, F.lit(56)).bitwiseOR(c("user_id"))
    return t.events.select("event_id", alloclog.event_fields(w).alias("e")).select("event_id", "e.*")


@twin("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INT) + l_linenumber AS ref_length, CAST(l_quantity AS INT) + 2 AS query_length FROM lineitem")
def cigar_expand(t):
    cigar = F.concat(c("l_quantity").cast("int"), F.lit("M"), c("l_linenumber"), F.lit("D2I"))
    ops = text.cigar_operations(cigar)
    total = lambda kinds: F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0), lambda a, o: a + o["len"])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", total("MD").alias("ref_length"), total("MI").alias("query_length"))


# --- arrays, matrices, chains -------------------------------------------------------------------------------------------

_ARR = "SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem GROUP BY l_orderkey"


def _array(name: str, column, sql: str) -> None:
    def f(t):
        arrays = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
        return arrays.select("l_orderkey", column().alias("v"))

    f.__name__ = name
    twin(f"SELECT l_orderkey, {sql} AS v FROM ({_ARR})")(f)


_joined = lambda x: F.array_join(x.cast("array<string>"), ",")
_array("arr_map", lambda: _joined(tuples.fmap("a", lambda x: x * x)), "array_to_string(list_transform(a, lambda x: x * x), ',')")
_array("arr_filter", lambda: _joined(tuples.keep("a", lambda x: x % 2 == 1)), "array_to_string(list_filter(a, lambda x: x % 2 = 1), ',')")
_array("arr_find", lambda: tuples.find("a", 3), "CAST(coalesce(list_position(a, 3), 0) - 1 AS INT)")
_array("arr_fold", lambda: tuples.foldl("a", F.lit(0).cast("bigint"), lambda s, x: s * 3 + x), "list_reduce(list_prepend(CAST(0 AS BIGINT), a), lambda s, x: s * 3 + x)")
_array("arr_unique", lambda: _joined(tuples.unique("a")), "array_to_string(list_sort(list_distinct(a)), ',')")
_array("arr_slice", lambda: _joined(tuples.slice_("a", 1, 4)), "array_to_string(a[2:4], ',')")
_array("arr_zip", lambda: _joined(tuples.pairwise_apply("a", F.reverse("a"), lambda x, y: x * 10 + y)), "array_to_string(list_transform(list_zip(a, list_reverse(a)), lambda z: z[1] * 10 + z[2]), ',')")
_array("arr_cat", lambda: _joined(tuples.cat("a", F.reverse("a"))), "array_to_string(list_concat(a, list_reverse(a)), ',')")
_array("arr_head_last", lambda: tuples.head("a") * 100 + tuples.last("a"), "a[1] * 100 + a[-1]")
_array("arr_cross", lambda: _joined(tuples.cross("a", F.array(F.lit(1), F.lit(2)), lambda x, y: x * 10 + y)), "array_to_string(flatten(list_transform(a, lambda x: list_transform([1, 2], lambda y: x * 10 + y))), ',')")
_array("arr_default", lambda: tuples.element_or("a", 4, -1), "coalesce(a[5], -1)")
_array("vector_push_reverse", lambda: _joined(vectors.reverse(vectors.push_back("a", 9))), "array_to_string(list_reverse(list_append(a, 9)), ',')")

_array("arr_erase", lambda: _joined(tuples.erase("a", lambda x: x % 2 == 1)), "array_to_string(list_filter(a, lambda x: x % 2 <> 1), ',')")
_array("arr_group_by", lambda: F.array_join(F.transform(tuples.group_by("a", lambda x: x % 2), lambda g: F.concat(g["key"].cast("string"), F.lit(":"), F.size(g["elements"]).cast("string"))), ";"), "array_to_string(list_transform(list_filter([a[1] % 2, 1 - a[1] % 2], lambda k: len(list_filter(a, lambda x: x % 2 = k)) > 0), lambda k: k || ':' || len(list_filter(a, lambda x: x % 2 = k))), ';')")
_array("vector_pack", lambda: F.array_join(vectors.pack("a", 16).cast("array<string>"), ","), "array_to_string(list_transform(generate_series(1, len(a), 4), lambda s: CAST(list_sum(list_transform(generate_series(s, least(s + 3, len(a))), lambda i: CAST(a[i] AS BIGINT) << CAST((i - s) * 16 AS INT))) AS BIGINT)), ',')")
_array("vector_load", lambda: vectors.load(vectors.pack("a", 8), F.size("a") - 1, 8), "CAST(a[len(a)] AS BIGINT)")


@twin("SELECT r_regionkey AS row, n_nationkey AS col, CAST(length(n_name) AS INT) AS val FROM nation JOIN region ON n_regionkey = r_regionkey")
def matrix_transpose(t):
    return matrices.transpose(t.nation.select(c("n_nationkey").alias("row"), c("n_regionkey").alias("col"), F.length("n_name").alias("val")))


@twin("SELECT c_nationkey AS col, count(*) AS val FROM customer WHERE length(c_mktsegment) = 8 GROUP BY ALL")
def matrix_row(t):
    return matrices.row(_segments(t), 8)


def _segments(t):
    """Customers by the length of their segment's name and by nation."""
    return t.customer.groupBy(F.length("c_mktsegment").alias("row"), c("c_nationkey").alias("col")).agg(F.count("*").alias("val"))


@twin("SELECT CAST(length(c_mktsegment) AS INT) AS row, count(*) AS val FROM customer WHERE c_nationkey = 3 GROUP BY ALL")
def matrix_column(t):
    return matrices.column(_segments(t), 3)


@twin("SELECT row, col, val FROM (SELECT CAST(length(c_mktsegment) AS BIGINT) AS row, CAST(c_nationkey AS BIGINT) AS col, count(*) AS val FROM customer WHERE c_nationkey <> 30 GROUP BY ALL) UNION ALL SELECT i, 30, CASE WHEN i % 2 = 0 THEN 5 ELSE 6 END FROM (SELECT unnest(generate_series(0, 9)) AS i)")
def matrix_fill_column(t):
    return matrices.fill_column(_segments(t).select(c("row").cast("bigint").alias("row"), c("col").cast("bigint").alias("col"), "val"), 30, 10, [5, 6])


@twin("SELECT idx, val, lag(idx) OVER (ORDER BY idx) AS previous, lead(idx) OVER (ORDER BY idx) AS next FROM (SELECT o_orderkey AS idx, o_custkey AS val FROM orders WHERE o_orderstatus = 'F')")
def array_list_links(t):
    return matrices.link(t.orders.where("o_orderstatus = 'F'").select(c("o_orderkey").alias("idx"), c("o_custkey").alias("val")))


@twin("""WITH n AS (SELECT event_type AS s, nxt, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY ALL)
SELECT s AS src, string_agg(nxt || ':' || upto, ',' ORDER BY nxt) AS targets FROM (SELECT s, nxt, CAST(sum(n) OVER (PARTITION BY s ORDER BY nxt) AS BIGINT) AS upto FROM n) GROUP BY s""")
def markov_transitions(t):
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    n = t.events.select(c("event_type").alias("src"), nxt.alias("dst")).where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("p"))
    return chains.thresholds(n).select("src", F.array_join(F.transform("targets", lambda x: F.concat(x["dst"], F.lit(":"), x["upto"].cast("string"))), ",").alias("targets"))


_WALK_WEIGHT = "1 + length(a.event_type) * length(b.event_type) % 5"


@twin(f"""WITH RECURSIVE types AS (SELECT DISTINCT event_type FROM events),
cum AS (SELECT a.event_type AS src, b.event_type AS dst, sum({_WALK_WEIGHT}) OVER (PARTITION BY a.event_type ORDER BY b.event_type) AS upto, row_number() OVER (PARTITION BY a.event_type ORDER BY b.event_type DESC) AS back FROM types a, types b),
steps AS (SELECT user_id, event_id % 9 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
walk(user_id, step, state) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'click' FROM events
  UNION ALL SELECT w.user_id, s.step, (SELECT coalesce(min(dst) FILTER (upto > s.p), min(dst) FILTER (back = 1)) FROM cum WHERE src = w.state) FROM walk w JOIN steps s ON s.user_id = w.user_id AND s.step = w.step + 1)
SELECT user_id AS walk, string_agg(state, ',' ORDER BY step) AS states FROM walk GROUP BY user_id""")
def markov_walk(t):
    types = t.events.agg(F.collect_set("event_type").alias("all"))  # an enumeration of few values
    pairs = types.select("all", F.explode("all").alias("src")).select("src", F.explode("all").alias("dst"))
    weights = pairs.withColumn("p", 1 + F.length("src") * F.length("dst") % 5)
    steps = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (c("event_id") % 9).alias("p")))).alias("s"))
    walks = steps.select(c("user_id").alias("walk"), c("s.p").alias("probabilities"))
    return chains.walk(weights, walks, "click").select("walk", F.array_join("states", ",").alias("states"))


@twin(f"""SELECT concat_ws(chr(9), 'chr0', pos, CASE WHEN pos % 4 = 0 THEN 'id' || row_number() OVER (PARTITION BY pos % 4 = 0 ORDER BY pos) ELSE 'rs' || pos END, 'A', 'T', '.', 'PASS', '.', 'PS', ps) AS line
FROM (SELECT pos, string_agg(coalesce(CAST(ps AS VARCHAR), '.'), chr(9) ORDER BY l_linenumber, l_partkey, l_suppkey, q) AS ps FROM {_ROWS} WHERE chrom = 'chr0' GROUP BY pos)""")
def cat_end_to_end(t):
    kept = variants.cat(_records(t), chrom="chr0", snps=True, missing_id_prefix="id", omit_info=True, formats=["PS"], order=("pos",))
    return vcf.record_text(kept, True).select(c("value").alias("line"))


@twin(f'SELECT count(*) AS records, count(*) FILTER (event_type = \'click\') AS chrom_mismatches, count(*) FILTER (event_type <> \'click\' AND NOT EXISTS (SELECT 1 FROM ({_MERGED}) r WHERE r.chrom = v.event_type AND r."begin" <= v.event_id % 20000 - 1 AND v.event_id % 20000 - 1 < r."end")) AS position_mismatches FROM events v')
def region_counts(t):
    rows = t.events.select(c("event_type").alias("chrom"), (c("event_id") % 20000).alias("pos"))
    return variants.region_counts(rows, _regions(t).where("chrom <> 'click'"))