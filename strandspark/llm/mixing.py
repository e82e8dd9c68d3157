"""Operator 1: mix sources to target weights.

Every document gets a hash-random key. Within each source the rows are dealt to ranges of that key, the ranges'
token sums give each range its offset (a prefix sum over at most ``RANGES`` rows a source), and the range in which the source's exact
budget ends is sorted to find the row at which it does. Whole epochs repeat every document; the last, partial epoch takes the rows
before that one, and cuts inside it. Sums run over a narrow table of sizes and hashes; documents are only compared with the cut.

Defined cases: null text counts 0 words; null source is a source of its own and comes last; the key is made of id, source and text, so
rows with equal keys are repeats and interchangeable; an empty table gives an empty result; if no document has
a word, all targets are 0. Documents without words are in whole epochs only. Other columns are ignored by :func:`mix` and kept by :func:`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.llm._shared import P, materialize, ordinal

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the hash key in each source; a hot source is spread over all of them.
RANGES = 1024
#: The order of a source's rows in the last epoch.
ORDER = ("range", "key", "id", "size", "digest")


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def water_level(sources: DataFrame, total: int, max_epochs: float) -> float:
    """Level l with sum(min(weight * l, max_epochs * size)) = total; each round caps more sources and shares the rest."""
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col(f"{P}w") * F.lit(level) > F.lit(float(max_epochs)) * F.col(f"{P}ssize")
        row = sources.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.coalesce(F.sum(F.when(over, F.lit(float(max_epochs)) * F.col(f"{P}ssize"))), F.lit(0.0)).alias("cap"),
            F.coalesce(F.sum(F.when(~over, F.col(f"{P}w"))), F.lit(0.0)).alias("w"),
        ).first()
        if row["n"] == capped or not row["w"]:
            return level or 0.0
        capped, level = row["n"], (total - row["cap"]) / row["w"]


def source_targets(sizes: DataFrame, weights: tuple, share: float, max_epochs: float) -> DataFrame:
    """One row a source: its position, size, weight, target, whole epochs and the budget of the last epoch."""
    per = sizes.groupBy(f"{P}source").agg(F.sum(f"{P}size").alias(f"{P}ssize"))
    ranked = ordinal(per, [F.col(f"{P}source").asc_nulls_last()], f"{P}sk")
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = materialize(ranked.withColumn(f"{P}w", F.element_at(w, (F.pmod(F.col(f"{P}sk") - 1, F.lit(len(weights))) + 1).cast("int"))), "mix-sources")
    total = float(ranked.agg(F.sum(f"{P}ssize")).first()[0] or 0) * share
    level = water_level(ranked, total, max_epochs)
    target = F.least(F.col(f"{P}w") * F.lit(level), F.lit(float(max_epochs)) * F.col(f"{P}ssize"))
    size = F.nullif(F.col(f"{P}ssize"), F.lit(0))
    whole = F.coalesce(F.floor(F.col(f"{P}target") / size), F.lit(0)).cast("bigint")
    return (
        ranked.withColumn(f"{P}target", target.cast("double"))
        .withColumn(f"{P}whole", whole)
        .withColumn(f"{P}budget", F.floor(F.col(f"{P}target") - F.col(f"{P}whole") * F.col(f"{P}ssize")).cast("bigint"))
    )


def _tuple(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{P}{prefix}{c}") for c in ORDER])


def cut_places(stats: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with the place of the cut in the order of each source's rows: the row (key, id, size, text's hash) at which the budget
    ends, how many rows are equal to it, and the words that these take. Null where a source has no last epoch."""
    here = [f"{P}sk", f"{P}range"]
    named = sources.select(F.col(f"{P}source").alias(f"{P}s"), f"{P}sk", f"{P}budget").where(f"{P}budget > 0")
    rows = stats.join(named, F.col(f"{P}source").eqNullSafe(F.col(f"{P}s"))).drop(f"{P}s")
    ranges = rows.groupBy(*here, f"{P}budget").agg(F.sum(f"{P}size").alias(f"{P}rsize"))
    w = Window.partitionBy(f"{P}sk").orderBy(f"{P}range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn(f"{P}before", F.coalesce(F.sum(f"{P}rsize").over(w), F.lit(0)))
    ends = lambda before, size: (before < F.col(f"{P}budget")) & (F.col(f"{P}budget") <= before + size)
    last = materialize(offsets.where(ends(F.col(f"{P}before"), F.col(f"{P}rsize"))).select(*here, f"{P}before"), "mix-ranges")
    inside = rows.join(last, here).groupBy(f"{P}sk", f"{P}budget", f"{P}before", *[f"{P}{c}" for c in ORDER]).agg(F.count("*").alias(f"{P}n"))
    words_ = F.col(f"{P}size") * F.col(f"{P}n")
    w = Window.partitionBy(f"{P}sk").orderBy(*[f"{P}{c}" for c in ORDER]).rowsBetween(Window.unboundedPreceding, -1)
    placed = inside.withColumn(f"{P}before", F.col(f"{P}before") + F.coalesce(F.sum(words_).over(w), F.lit(0)))
    cut = placed.where(ends(F.col(f"{P}before"), words_)).select(f"{P}sk", *[F.col(f"{P}{c}").alias(f"{P}c_{c}") for c in ORDER], F.col(f"{P}n").alias(f"{P}c_n"), (F.col(f"{P}budget") - F.col(f"{P}before")).alias(f"{P}c_left"))
    return sources.join(cut, f"{P}sk", "left")


def plan_mix(docs: DataFrame, stats: DataFrame, *, weights=(1, 2, 3), share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """Add to ``docs`` (which has the helper columns of :func:`prepared`) the decision ``taken``; ``stats`` is a narrow
    written copy of the same rows, read for the sums. A row is compared with its source's cut, so no document is shuffled; where
    several rows are equal to a cut, only these are numbered."""
    sources = materialize(source_targets(stats, weights, share, max_epochs), "mix-targets")
    cuts = materialize(cut_places(stats, sources), "mix-cuts")
    named = cuts.withColumnRenamed(f"{P}source", f"{P}s")
    out = docs.join(named, F.col(f"{P}source").eqNullSafe(F.col(f"{P}s"))).drop(f"{P}s")
    none, at = F.col(f"{P}c_n").isNull(), _tuple("c_")
    part = F.when(none, F.lit(0)).when(_tuple() < at, F.col(f"{P}size")).when(_tuple() > at, F.lit(0)).otherwise(F.col(f"{P}c_left")).cast("bigint")
    tied = ~none & (F.col(f"{P}c_n") > 1) & _tuple().eqNullSafe(at)
    if cuts.where(f"{P}c_n > 1").isEmpty():
        out = out.withColumn(f"{P}part", part)
    else:
        rank = F.row_number().over(Window.partitionBy(f"{P}sk").orderBy(f"{P}key"))
        whole = F.floor(F.col(f"{P}c_left") / F.col(f"{P}size"))
        shared = F.when(F.col(f"{P}rank") <= whole, F.col(f"{P}size")).when(F.col(f"{P}rank") == whole + 1, F.col(f"{P}c_left") - whole * F.col(f"{P}size")).otherwise(F.lit(0)).cast("bigint")
        equal = out.where(tied).withColumn(f"{P}rank", rank).withColumn(f"{P}part", shared).drop(f"{P}rank")
        out = out.where(~tied).withColumn(f"{P}part", part).unionByName(equal)
    return out.withColumn(f"{P}taken", F.col(f"{P}whole") * F.col(f"{P}size") + F.col(f"{P}part"))


def prepared(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    digest = F.xxhash64(F.col(text_col))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), digest)
    return (
        docs.withColumn(f"{P}id", F.col(id_col)).withColumn(f"{P}source", F.col(source_col)).withColumn(f"{P}size", words(text_col)).withColumn(f"{P}digest", digest)
        .withColumn(f"{P}key", key).withColumn(f"{P}range", F.shiftrightunsigned(f"{P}key", 64 - RANGES.bit_length() + 1))
    )


def _stats(base: DataFrame) -> DataFrame:
    return materialize(base.select(*[f"{P}{c}" for c in ("id", "source", "size", "digest", "key", "range")]), "mix-sizes")


def mix(docs: DataFrame, *, id_col="doc_id", source_col="source", text_col="text", weights=(1, 2, 3), share=1.0, max_epochs=3, seed=17) -> DataFrame:
    """One row per document: id, source, size, source_size, target (its source's), taken (words, repeats counted)."""
    stats = _stats(prepared(docs.select(id_col, source_col, text_col), id_col, source_col, text_col, seed))
    out = plan_mix(stats, stats, weights=weights, share=share, max_epochs=max_epochs)
    names = {"id": id_col, "source": source_col, "size": "size", "ssize": "source_size", "target": "target", "taken": "taken"}
    return out.select(*[F.col(f"{P}{k}").alias(v) for k, v in names.items()])


def mix_documents(docs: DataFrame, *, id_col="doc_id", source_col="source", text_col="text", weights=(1, 2, 3), share=1.0, max_epochs=3, seed=17) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each repeat; the cut document's last copy keeps its first
    words, joined by one space, and if there is a column n_chars, it then holds that text's length."""
    base = prepared(docs, id_col, source_col, text_col, seed)
    out = plan_mix(base, _stats(base), weights=weights, share=share, max_epochs=max_epochs)
    copies = F.col(f"{P}whole").cast("int") + F.when(F.col(f"{P}part") > 0, 1).otherwise(0)
    kept = out.where(copies > 0).withColumn(f"{P}copy", F.explode(F.sequence(F.lit(1), copies)))
    cut = (F.col(f"{P}copy") > F.col(f"{P}whole")) & (F.col(f"{P}part") < F.col(f"{P}size"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col(f"{P}part").cast("int")), " ")
    text = F.when(cut, first).otherwise(F.col(text_col))
    chars = {"n_chars": F.when(cut, F.length(first)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return kept.select(*[(text if c == text_col else chars.get(c, F.col(c))).alias(c) for c in docs.columns])
