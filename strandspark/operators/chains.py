"""Markov chains as relations: cumulative transition thresholds, walks by given probabilities, and generators of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative(transitions: DataFrame) -> DataFrame:
    """(src, dst, p) -> with the sum of the weights up to dst and of all, in the order of dst."""
    w = Window.partitionBy("src")
    return transitions.withColumn("upto", F.sum("p").over(w.orderBy("dst"))).withColumn("total", F.sum("p").over(w))


def thresholds(transitions: DataFrame) -> DataFrame:
    """(src, dst, p) -> src and its targets as an array of (cumulative, dst) in the order of dst."""
    return cumulative(transitions).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("upto", "dst"))).alias("targets"))


def normalised(counts: DataFrame) -> DataFrame:
    """(src, dst, n) -> (src, dst, p), the weights of a state summing to 1."""
    return counts.select("src", "dst", (F.col("n") / F.sum("n").over(Window.partitionBy("src"))).alias("p"))


#: Transitions that go with every task of a walk, at most.
MOST_TRANSITIONS = 1_000_000


def walk(transitions: DataFrame, walks: DataFrame, start: str) -> DataFrame:
    """(walk, probabilities array) -> walk and the states visited. Each step goes to the first target whose cumulative
    probability is above the step's, or to the last one. The chain goes with every task as one map; a chain of more than
    ``MOST_TRANSITIONS`` transitions is joined step by step instead."""
    if transitions.limit(MOST_TRANSITIONS + 1).count() > MOST_TRANSITIONS:
        return walk_by_steps(transitions, walks, start)
    chain = thresholds(transitions).agg(F.map_from_entries(F.collect_list(F.struct("src", "targets"))).alias("chain"))

    def step(path, p):
        targets = F.col("chain")[F.element_at(path, -1)]
        above = F.filter(targets, lambda t: t["upto"] > p)
        return F.array_append(path, F.coalesce(F.get(above, F.lit(0))["dst"], F.element_at(targets, -1)["dst"]))

    path = F.aggregate("probabilities", F.array(F.lit(start)), step)
    return walks.join(F.broadcast(chain), F.lit(True)).select("walk", path.alias("states"))


def walk_by_steps(transitions: DataFrame, walks: DataFrame, start: str) -> DataFrame:
    """The same walks by an equi-join on the state for every step, whatever the chain's size."""
    from strandspark.operators.positions import checkpointed

    chain = thresholds(transitions)
    at = checkpointed(walks.select("walk", "probabilities", F.array(F.lit(start)).alias("states")))
    longest = at.agg(F.max(F.size("probabilities"))).first()[0] or 0
    for i in range(longest):
        joined = at.join(chain, F.element_at("states", -1) == F.col("src"), "left")
        above = F.filter("targets", lambda t: t["upto"] > F.get("probabilities", F.lit(i)))
        following = F.coalesce(F.get(above, F.lit(0))["dst"], F.element_at("targets", -1)["dst"])
        more = F.size("probabilities") > i
        at = checkpointed(joined.select("walk", "probabilities", F.when(more, F.array_append("states", following)).otherwise(F.col("states")).alias("states")))
    return at.select("walk", "states")


def generated(spark, walks: int, steps: int, seed: int = 1) -> DataFrame:
    """(walk, probabilities): uniform numbers from a hash of seed, walk and step, the same on every run."""
    one = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), i), 11) / F.lit(float(1 << 53))
    steps_ = F.transform(F.sequence(F.lit(1), F.lit(steps)), one) if steps else F.expr("cast(array() as array<double>)")
    return spark.range(walks).select(F.col("id").alias("walk"), steps_.alias("probabilities"))


def simulate(transitions: DataFrame, start: str, walks: int, steps: int, seed: int = 1) -> DataFrame:
    """Walks of generated probabilities; the weights of a state have to sum to 1."""
    return walk(transitions, generated(transitions.sparkSession, walks, steps, seed), start)
