"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm._shared import discard, materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over written edges (a > b), which it deletes. The least neighbour of each node is pre-aggregated before the shuffle and written
    out, so the join back has two plain exchanges and adaptive execution may split a hub's rows."""
    if small:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
    joined = near.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.where("u <> m").select("u", "m"))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = materialize(out.where("a > b").distinct(), "cc-edges")
    discard(edges, least)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: long); component is the least reachable node.

    Nulls and self links are ignored; an empty table gives an empty result. The loop stops at a fixed point; it raises
    rather than return an unfinished labelling."""
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "cc-edges")
    seen = None
    for _ in range(max_rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or now[0] == 0:
            break
        seen = now
        e = _star(_star(e, small=False), small=True)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b")).distinct()
