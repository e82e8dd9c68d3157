"""Positional Burrows-Wheeler analysis of aligned sequences (row_idx, seq) of equal length.

At column c (from 0) rows are ordered by their reversed prefixes of c + 1 characters, then by row. The divergence of a row is the
first column from which it agrees with the row before it up to c; the first row's is c + 1.

A column is a row of arrays with an element per sequence. Classes of equal reversed substrings are found by doubling: the class of
2^(j+1) characters up to c is the class of 2^j up to c with that of 2^j up to c - 2^j, so log2(length) rounds, each a join
of the columns with themselves, order all prefixes, and columns are independent tasks in each. With the classes go the number of
characters on which a class agrees with the one before it, and the last unknown character. A task holds a few columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.operators import positions

#: Columns whose characters are cut out of a sequence together.
WIDTH = 1024
_STATE = "col int, class array<int>, agree array<int>, unknown array<int>"


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for each pair (lo < hi), by a table of the minima of 2^k neighbours."""
    out, size = np.empty(len(lo), values.dtype), hi - lo
    level, width = values, 1
    while len(lo) and width <= size.max():
        now = (size >= width) & (size < 2 * width)
        out[now] = np.minimum(level[lo[now]], level[hi[now] - width])
        if 2 * width <= len(values):
            level = np.minimum(level[: len(level) - width], level[width:])
        width *= 2
    return out


def _doubled(part: pd.DataFrame, step: int) -> Iterator[tuple]:
    for col, a, agree, unknown, b, agree_b, unknown_b in zip(*(part[c] for c in ("col", "class", "agree", "unknown", "class_b", "agree_b", "unknown_b"))):
        if b is None:  # the prefix is no longer than what is ordered
            yield col, a, agree, unknown
            continue
        pair, first, new = np.unique(a.astype(np.int64) * len(a) + b, return_index=True, return_inverse=True)
        own, earlier = a[first], b[first]
        alike = agree[own].copy()
        same = np.flatnonzero(np.r_[False, own[1:] == own[:-1]])
        alike[same] = step + _range_min(agree_b, earlier[same - 1] + 1, earlier[same] + 1)
        yield col, new.astype(np.int32), alike, np.maximum(unknown, unknown_b)


def columns(rows: DataFrame, unknown: str = "") -> DataFrame:
    """(col, class, agree, unknown): by sequence, the class of its prefix up to the column in the order of reversed prefixes;
    by class, on how many characters it agrees with the one before; by sequence, the last column up to here that holds the unknown
    character (-1 if none). Sequences are in the order of row_idx."""
    cut = F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{WIDTH}}}"), F.lit(0))).alias("block", "text")
    parts = positions.numbered(rows.select("row_idx", "seq"), ["row_idx", "seq"], "row").select("row", cut)

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        text = pdf["text"].tolist()
        if len(set(map(len, text))) > 1 or not (pdf["row"].to_numpy() == np.arange(1, len(text) + 1)).all():
            raise ValueError("aligned sequences have to be of equal length")
        cells = np.array([np.frombuffer(t.encode("utf-32-le"), "<u4") for t in text]).T
        at, out = int(pdf["block"].iloc[0]) * WIDTH, []
        for i, line in enumerate(cells):
            chars, cls = np.unique(line, return_inverse=True)
            last = np.where(line == ord(unknown), at + i, -1) if unknown else np.full(len(line), -1)
            out.append((at + i, cls.astype(np.int32), np.zeros(len(chars), np.int32), last.astype(np.int32)))
        return pd.DataFrame(out, columns=["col", "class", "agree", "unknown"])

    state = positions.checkpointed(parts.groupBy("block").applyInPandas(start, _STATE))
    length, step = state.count(), 1
    while step < length:
        earlier = state.select((F.col("col") + step).alias("col"), *[F.col(c).alias(f"{c}_b") for c in ("class", "agree", "unknown")])

        def next_round(batches: Iterator[pd.DataFrame], step=step) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame(list(_doubled(b, step)), columns=["col", "class", "agree", "unknown"])

        state = positions.checkpointed(state.join(earlier, "col", "left").mapInPandas(next_round, _STATE))
        step *= 2
    return state


def _order(cls: np.ndarray, agree: np.ndarray, col: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequences in order, and the divergence of each in it."""
    order = np.argsort(cls, kind="stable")
    sorted_ = cls[order]
    first = np.r_[True, sorted_[1:] != sorted_[:-1]]
    return order, np.where(first, col + 1 - agree[sorted_], 0)


def _row_ids(rows: DataFrame) -> DataFrame:
    return positions.numbered(rows.select("row_idx", "seq"), ["row_idx", "seq"], "row").select((F.col("row") - 1).alias("_row"), "row_idx")


def ranked(rows: DataFrame) -> DataFrame:
    """(col, row_idx, rank, divergence), rank from 0."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for col, cls, agree in zip(b["col"], b["class"], b["agree"]):
                order, divergence = _order(cls, agree, col)
                yield pd.DataFrame({"col": col, "_row": order, "rank": np.arange(len(order)), "divergence": divergence})

    out = columns(rows).mapInPandas(listed, "col int, _row bigint, rank bigint, divergence bigint")
    return out.join(_row_ids(rows), "_row").select("col", "row_idx", "rank", "divergence")


def divergence_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("col", "divergence").agg(F.count("*").alias("n"))


def unique_substring_count(table: DataFrame, bound: int) -> DataFrame:
    """Distinct substrings from ``bound`` to each column."""
    return table.groupBy("col").agg(F.count_if(F.col("divergence") > bound).alias("n"))


def substring_copies(rows: DataFrame, length: int, bound: int) -> DataFrame:
    """(col, copies, first_row): by distinct substring from ``bound`` to the column, its number of rows and the least of them."""
    at = F.explode(F.sequence(F.lit(bound), F.lit(length - 1))).alias("col")
    cut = rows.select("row_idx", "seq", at).withColumn("_s", F.substr("seq", F.lit(bound + 1), F.col("col") - bound + 1))
    return cut.groupBy("col", "_s").agg(F.count("*").alias("copies"), F.min("row_idx").alias("first_row")).drop("_s")


def substring_runs(rows: DataFrame, length: int, bound: int) -> DataFrame:
    """(col, row_idx, copies, first_row): by row, the number of rows with the same substring from ``bound`` to the column and the least
    of them. A run of the order with divergence <= bound is one distinct substring, so it is found by grouping that substring."""
    at = F.explode(F.sequence(F.lit(bound), F.lit(length - 1))).alias("col")
    cut = rows.select("row_idx", "seq", at).withColumn("_s", F.substr("seq", F.lit(bound + 1), F.col("col") - bound + 1)).drop("seq")
    per = cut.groupBy("col", "_s").agg(F.count("*").alias("copies"), F.min("row_idx").alias("first_row"))
    return cut.join(per, ["col", "_s"]).drop("_s")


def identity_regions(rows: DataFrame, least: int, unknown: str = "") -> DataFrame:
    """(position, leader, row_idx, length): runs of columns in which a row agrees with a leader on at least ``least`` characters
    up to the column, reported at their last column with the agreement there. At a column, rows that follow each other in the order
    with so many characters in common share a leader, the first of them. An ``unknown`` character, if given, ends an agreement, but
    does not make another leader."""
    if least < 1:
        raise ValueError("the length has to be positive")

    def leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for col, cls, agree, last in zip(*(b[c] for c in ("col", "class", "agree", "unknown"))):
                order, divergence = _order(cls, agree, col)
                head = col + 1 - divergence < least
                head[0] = True
                lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
                size = col + 1 - np.maximum(divergence, last[order] + 1)
                of, length = np.full(len(order), -1, np.int32), np.zeros(len(order), np.int32)
                matched = ~head & (size >= least)
                of[order[matched]], length[order[matched]] = lead[matched], size[matched]
                out.append((col, of, length))
            yield pd.DataFrame(out, columns=["col", "leader", "length"])

    found = positions.checkpointed(columns(rows, unknown).mapInPandas(leaders, "col int, leader array<int>, length array<int>"))
    after = found.select((F.col("col") - 1).alias("col"), F.col("leader").alias("next"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for col, leader, length, following in zip(*(b[c] for c in ("col", "leader", "length", "next"))):
                at = np.flatnonzero((leader >= 0) & (True if following is None else leader != following))
                yield pd.DataFrame({"position": col, "_lead": leader[at], "_row": at, "length": length[at]})

    last = found.join(after, "col", "left").mapInPandas(ends, "position int, _lead bigint, _row bigint, length int")
    ids = _row_ids(rows)
    lead = ids.select(F.col("_row").alias("_lead"), F.col("row_idx").alias("leader"))
    return last.join(ids, "_row").join(lead, "_lead").select("position", "leader", "row_idx", "length")
