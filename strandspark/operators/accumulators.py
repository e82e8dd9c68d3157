"""Mergeable statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Number, sum, mean, least and greatest of the values that are not null; without one all but the number are null."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def count_items(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def key_range(df: DataFrame, key: str) -> DataFrame:
    """One row: least and greatest key, null without rows."""
    return df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))


def across_parts(df: DataFrame, by: list[str], part: str, value: str, kind: str) -> DataFrame:
    """Sums within parts, then the minimum or maximum of them: ``kind`` is min or max."""
    sums = df.groupBy(*by, part).agg(F.sum(value).alias("_s"))
    return sums.groupBy(*by).agg({"min": F.min, "max": F.max}[kind]("_s").alias(f"{kind}_sum"))


def moments(x: str, y: str) -> list[Column]:
    """State of a correlation that merges by addition after centring: n, means and central sums."""
    return [F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_pop(x) * F.count(x)).alias("sxx"), (F.var_pop(y) * F.count(y)).alias("syy"), (F.covar_pop(x, y) * F.count(x)).alias("sxy")]


def merged_moments(states: DataFrame, by: list[str]) -> DataFrame:
    """Pairwise update of states: the grand means, and central sums with the means' spread added."""
    n, mx, my = F.sum("n"), F.sum(F.col("n") * F.col("mx")) / F.nullif(F.sum("n"), F.lit(0)), F.sum(F.col("n") * F.col("my")) / F.nullif(F.sum("n"), F.lit(0))
    raw = states.groupBy(*by).agg(
        n.alias("n"), mx.alias("mx"), my.alias("my"), F.sum(F.col("sxx") + F.col("n") * F.col("mx") ** 2).alias("xx"), F.sum(F.col("syy") + F.col("n") * F.col("my") ** 2).alias("yy"), F.sum(F.col("sxy") + F.col("n") * F.col("mx") * F.col("my")).alias("xy"),
    )
    c = F.col
    return raw.select(*by, "n", "mx", "my", (c("xx") - c("n") * c("mx") ** 2).alias("sxx"), (c("yy") - c("n") * c("my") ** 2).alias("syy"), (c("xy") - c("n") * c("mx") * c("my")).alias("sxy"))


def correlation(state: str = "") -> Column:
    """Pearson's r of a state, within [-1, 1]; NaN if a variance is zero, null without rows."""
    d = F.sqrt(F.greatest(F.col("sxx"), F.lit(0.0)) * F.greatest(F.col("syy"), F.lit(0.0)))
    return F.when(F.col("n") == 0, F.lit(None).cast("double")).when(d == 0, F.lit(float("nan"))).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sxy") / F.nullif(d, F.lit(0.0)))))


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(*moments(x, y)).select(*by, correlation().alias("r"))


def first_extremes(df: DataFrame, by: list[str], value: str, index: str) -> DataFrame:
    """The first index of the least and of the greatest value; an aggregate, so it combines before the shuffle."""
    low = F.min(F.struct(F.col(value), F.col(index)))
    high = F.max(F.struct(F.col(value), (-F.col(index)).alias("_i")))
    return df.groupBy(*by).agg(low[index].alias("argmin"), (-high["_i"]).alias("argmax"))


def argmax_mask(df: DataFrame, by: list[str], value: str, index: str) -> DataFrame:
    """Bits of all indices (below 63) that have the greatest value."""
    top = df.groupBy(*by).agg(F.max(value).alias("_m"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(index).cast("int"))
    return df.join(top, by).where(F.col(value) == F.col("_m")).groupBy(*by).agg(F.bit_or(bit).alias("mask"))


def rollup_sizes(nodes: DataFrame, depth: int) -> DataFrame:
    """Sizes (id, parent, size) added to all ancestors, level by level from the leaves, ``depth`` levels at most."""
    up, total = nodes.select("id", "parent", "size"), nodes.select("id", "size")
    links = nodes.select(F.col("id").alias("_id"), F.col("parent").alias("_parent"))
    for _ in range(depth):
        up = up.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("size"))
        total = total.unionByName(up)
        up = up.join(links, F.col("id") == F.col("_id")).select("id", F.col("_parent").alias("parent"), "size")
    return total.groupBy("id").agg(F.sum("size").alias("size"))
