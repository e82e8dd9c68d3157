"""Operators over rows in a given order: distances, runs, intervals, merges, sorts and partitions.

``large_groups`` is for groups that one task cannot sort, such as a chromosome: rows are dealt to ranges of the order, which
carry what the rows before them add up to (see :mod:`strandspark.operators.positions`); the rows are written once or twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.operators import positions


def distances(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "distance", large_groups: bool = False) -> DataFrame:
    """Difference to the row before in the group; the first row of a group is left out. ``large_groups`` is for groups that
    one task cannot sort, such as a chromosome; it writes the rows once."""
    if large_groups:
        near = positions.with_previous(df, by, order, value, "_previous")
        return near.withColumn(name, F.col(value) - F.col("_previous")).drop("_previous").where(F.col(name).isNotNull())
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.col(value) - F.lag(value).over(w)).where(F.col(name).isNotNull())


def unsorted_rows(df: DataFrame, by: list[str], order: list[str], value: str, large_groups: bool = False) -> DataFrame:
    """Rows whose value is less than the one before."""
    if large_groups:
        near = positions.with_previous(df, by, order, value, "previous")
    else:
        near = df.withColumn("previous", F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))
    return near.where(F.col(value) < F.col("previous"))


def run_numbers(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "run", large_groups: bool = False) -> DataFrame:
    """Number the runs of equal neighbouring values."""
    if large_groups:
        # a box tells a null value from no row before
        boxed = df.withColumn("_value", F.struct(F.col(value).alias("v")))
        near = positions.with_previous(boxed, by, order, "_value", "_before")
        change = F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.v"))
        return positions.running(near.withColumn("_new", change.cast("int")).drop("_value", "_before"), by, order, "_new", name).drop("_new")
    w = Window.partitionBy(*by).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn("_new", change.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_lengths(df: DataFrame, by: list[str], order: list[str], value: str, large_groups: bool = False) -> DataFrame:
    """One row per run of equal neighbouring values, with its length."""
    return run_numbers(df, by, order, value, large_groups=large_groups).groupBy(*by, "run", value).agg(F.count("*").alias("n"))


def _islands(df: DataFrame, by: list[str], order: list[str], begin: str, end: str, touch: bool, large_groups: bool) -> DataFrame:
    """Add ``_island``: rows are in one with the rows before that reach them, with ``touch`` also those that end where they begin."""
    apart = (lambda reach: F.col(begin) > reach) if touch else (lambda reach: F.col(begin) >= reach)
    if large_groups:
        reached = positions.running(df, by, order, end, "_reach", "max", before=True)
        marked = reached.withColumn("_new", F.when(apart(F.col("_reach")) | F.col("_reach").isNull(), 1).otherwise(0)).drop("_reach")
        # of rows that are equal in the order the one that opens an island has to be first again
        return positions.running(marked, by, [*order, F.desc("_new")], "_new", "_island").drop("_new")
    w = Window.partitionBy(*by).orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(apart(reach) | reach.isNull(), 1).otherwise(0))
    return marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_intervals(df: DataFrame, by: list[str], begin: str, end: str, large_groups: bool = False) -> DataFrame:
    """Half-open intervals merged where they overlap; touching ones stay apart."""
    marked = _islands(df, by, [begin, end], begin, end, False, large_groups)
    return marked.groupBy(*by, "_island").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("_island")


def in_regions(df: DataFrame, regions: DataFrame, key: str, pos: Column, bin_size: int = 1 << 14) -> DataFrame:
    """Rows whose position is in a region (key, begin, end) of their key. Both sides are dealt to bins of positions, so the
    join is an equi-join on (key, bin) that Spark may broadcast or shuffle by size; a region has a row for each bin it meets."""
    size = F.lit(bin_size)
    cut = regions.select(F.col(key).alias("_k"), F.col("begin").alias("_b"), F.col("end").alias("_e"))
    cut = cut.where("_e > _b").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_b") / size), F.floor((F.col("_e") - 1) / size))))
    here = df.withColumn("_pos", pos).withColumn("_at", F.floor(F.col("_pos") / size))
    match = (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_bin")) & (F.col("_pos") >= F.col("_b")) & (F.col("_pos") < F.col("_e"))
    return here.join(cut, match, "left_semi").drop("_pos", "_at")


def kway_merge(frames: list[DataFrame], order: list[str], source: str = "file_idx") -> DataFrame:
    """Same-schema inputs in one order; ties are in the order of the inputs."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn(source, F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out.orderBy(*order, source)


def merge_projected(left: DataFrame, right: DataFrame, key: str, stop_at: int | None = None) -> DataFrame:
    """Two ordered inputs (key, idx) merged, the right one first among ties. From its first key at or beyond
    ``stop_at`` on, a side contributes nothing more."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    if stop_at is not None:
        # a row a side: where it stops
        stops = both.where(F.col(key) >= stop_at).groupBy("side").agg(F.min("idx").alias("_stop"))
        both = both.join(F.broadcast(stops), "side", "left").where("_stop IS NULL OR idx < _stop").select(*left.columns, "side")
    return both.orderBy(key, F.desc("side"), "idx")


def stable_sort(df: DataFrame, key: Column, input_order: list[str], name: str = "position") -> DataFrame:
    """Positions of a stable sort."""
    return positions.numbered(df, [key, *input_order], name)


def stable_partition(df: DataFrame, predicate: Column, input_order: list[str], name: str = "position") -> DataFrame:
    """Positions with the rows that satisfy the predicate first, both parts in input order."""
    return stable_sort(df, F.when(predicate, 0).otherwise(1), input_order, name)


def remove_at(df: DataFrame, index: str, removed: DataFrame) -> DataFrame:
    return df.join(removed, index, "left_anti")


def validated(df: DataFrame, order: list[str], skip: Column, stop: Column) -> DataFrame:
    """The rows in order up to the first at which ``stop`` holds, without that row and without those at which ``skip`` holds (null is
    no). The place of the stop is one row, which goes to all tasks; nothing is sorted."""
    holds = lambda x: F.coalesce(x, F.lit(False))
    at = df.where(holds(stop)).agg(F.min(F.struct(*order)).alias("_stop"))
    return df.where(~holds(skip)).crossJoin(F.broadcast(at)).where(F.col("_stop").isNull() | (F.struct(*order) < F.col("_stop"))).drop("_stop")


def rank_before(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Occurrences of the group's kind before each row."""
    return positions.numbered(df, order, name, by).withColumn(name, F.col(name) - 1)


def fold_adjacent(df: DataFrame, by: list[str], order: list[str], begin: str, end: str, parts: list[str], large_groups: bool = False) -> DataFrame:
    """Chains of rows in which each begins where the last kept one ended; rows that overlap the last kept one are skipped.
    Whether a row is kept depends on the kept one before, so rows are folded in order. A row that begins beyond all ends before
    it depends on none of them: groups are cut there, and only rows that touch or overlap are listed together."""
    cut = _islands(df, by, order, begin, end, True, large_groups)
    item = F.struct(*order, F.col(begin).alias("_b"), F.col(end).alias("_e"), *parts)
    schema = df.select(item.alias("x")).schema["x"].dataType.simpleString()
    listed = cut.groupBy(*by, "_island").agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    start = F.struct(F.lit(None).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("chain"), F.expr(f"cast(array() as array<struct<chain:bigint,x:{schema}>>)").alias("kept"))

    def step(acc, x):
        skip = acc["end"].isNotNull() & (x["_b"] < acc["end"])
        chain = F.when(acc["end"].isNotNull() & (x["_b"] == acc["end"]), acc["chain"]).otherwise(acc["chain"] + 1)
        kept = F.array_append(acc["kept"], F.struct(chain.alias("chain"), x.alias("x")))
        return F.when(skip, acc).otherwise(F.struct(x["_e"].cast("bigint").alias("end"), chain.alias("chain"), kept.alias("kept")))

    folded = listed.select(*by, "_island", F.aggregate("_rows", start, step, lambda a: a["kept"]).alias("_kept"))
    islands = Window.partitionBy(*by).orderBy("_island").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.element_at("_kept", -1)["chain"]).over(islands), F.lit(0))
    kept = folded.withColumn("_before", before).select(*by, "_before", F.explode("_kept").alias("k"))
    return kept.select(*by, (F.col("_before") + F.col("k.chain")).alias("chain"), *[F.col(f"k.x.{c}").alias(c) for c in order], F.col("k.x._b").alias(begin), F.col("k.x._e").alias(end), *[F.col(f"k.x.{c}").alias(c) for c in parts if c not in order])
