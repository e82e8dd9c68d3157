"""Operator 10: SimHash near-duplicates by BK-trees.

A document's fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of its 3-word shingles. Only
distinct fingerprints are searched; equal ones need no search. Two fingerprints within distance 3 agree on at least one
of four disjoint bands of bits, so fingerprints are sharded by (band, value), and each shard gets a BK-tree whose children are
keyed by the integer Hamming distance to the parent; the search follows only edges within the radius. A shard of
more than ``SHARD`` fingerprints is sharded again by four bands of the bits that are left, which loses no pair, down to 5
levels; by then at most 15 bits are free, so no shard can hold more than 32,768. Trees are built where their shard's
queries are rather than broadcast, since no bound on all trees together is proven. A task builds and searches the trees of its
shards together, level by level, and returns a star of links for each connected part of a shard instead of all pairs.

The graph's nodes are fingerprints; ids only label them, so rows that share an id, or have none, are not one node.

Defined cases: null or empty text has fingerprint zero and is linked like any other; fewer than three words are one
shingle; repeated rows have equal fingerprints; rows with null ids get the component of their fingerprint, and link others
as any row does; a component that only rows with null ids have is labelled null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm._graph import components
from strandspark.llm._shared import P, materialize, partitions

RADIUS = 3
SHARD = 1024
LEVELS = 5
#: Rows of shards that one task searches at a time, at most about.
TASK_ROWS = 60_000
#: (query, node) pairs of one step of a search.
FRONTIER = 1 << 20


# --- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Words are split at ASCII white space after A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)])))
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(parts), 1 << 15):
        raw = np.frombuffer(b"".join([digest(p, seed) for p in parts[at : at + (1 << 15)]]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big")


def text_digest(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 3, digest: bool = False) -> DataFrame:
    """(doc_id, fp): fp as a signed long; with ``digest`` also that of the text."""
    more = [text_digest(text_col).alias("digest")] if digest else []

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield b.drop(columns="text").assign(fp=fp)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *more)
    return rows.mapInPandas(made, "doc_id bigint, fp bigint" + (", digest string" if digest else ""))


# --- trees ----------------------------------------------------------------------------------------------------------


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class BKForest:
    """BK-trees over the groups of one array, built and searched together; ``child[node, d]`` is the child at distance d."""

    def __init__(self, group: np.ndarray, values: np.ndarray):
        """``group``: sorted group numbers; values are distinct inside a group."""
        self.values, n = values, len(values)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        self.child = np.full((n, 65), -1, np.int32)
        flat = self.child.ravel()
        todo = np.flatnonzero(self.root != np.arange(n))
        at = self.root[todo]
        while len(todo):
            edge = at * 65 + _distance(values[todo], values[at])
            free = flat[edge] < 0
            _, firsts = np.unique(edge[free], return_index=True)
            new = np.flatnonzero(free)[firsts]
            flat[edge[new]] = todo[new]
            at = flat[edge].astype(np.int64)
            stay = at != todo
            todo, at = todo[stay], at[stay]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of the query's own tree within the radius, the query itself left out."""
        todo = [(queries, self.root[queries])]
        flat = self.child.ravel()
        while todo:
            q, node = todo.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = _distance(self.values[q], self.values[node])
            hit = (d <= radius) & (q != node)
            if hit.any():
                yield q[hit], node[hit]
            nq, nn = [], []
            for step in range(-radius, radius + 1):
                e = d + step
                ok = (e > 0) & (e <= 64)
                kid = flat[node[ok] * 65 + e[ok]]
                has = kid >= 0
                nq.append(q[ok][has])
                nn.append(kid[has].astype(np.int64))
            q, node = np.concatenate(nq), np.concatenate(nn)
            if len(q):
                todo.append((q, node))


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the pairs into ``label`` (each entry the least index of its part, as a star)."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        low, high = np.minimum(la[differ], lb[differ]), np.maximum(la[differ], lb[differ])
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def shard_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Star links (a, b) of ids that are connected inside a shard; ``pdf``: key, fp, id."""
    pdf = pdf.sort_values(["key", "fp"], kind="stable").drop_duplicates(["key", "fp"])
    key, values, ids = pdf["key"].to_numpy(), pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["id"].to_numpy(np.int64)
    alone = np.r_[True, key[1:] != key[:-1]] & np.r_[key[1:] != key[:-1], True] if len(key) else np.zeros(0, bool)
    key, values, ids = key[~alone], values[~alone], ids[~alone]
    forest, label = BKForest(key, values), np.arange(len(key))
    for q, node in forest.search(np.arange(len(key)), RADIUS):
        _join_labels(label, q, node)
    far = label != np.arange(len(key))
    return pd.DataFrame({"a": ids[far], "b": ids[label[far]]})


def _band_masks(levels: int) -> list[list[int]]:
    """By level, the bit mask of each path of bands: four bands of the bits left by the path so far."""
    left, out = [list(range(64))], []
    for _ in range(levels):
        masks, rest = [], []
        for bits in left:
            cut = [len(bits) * i // (RADIUS + 1) for i in range(RADIUS + 2)]
            for lo, hi in zip(cut, cut[1:]):
                masks.append(sum(1 << b for b in bits[lo:hi]))
                rest.append(bits[:lo] + bits[hi:])
        out.append(masks)
        left = rest
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect all ids whose fingerprints are within the radius; ``distinct``: fp (unique), id."""
    rows = distinct.select("fp", "id", F.lit(0).alias("path"), F.lit(0).cast("bigint").alias("key"))
    links = None
    for level, masks in enumerate(_band_masks(LEVELS)):
        bands = F.posexplode(F.array(*[F.lit(i) for i in range(RADIUS + 1)])).alias("p", "band")
        rows = rows.select("fp", "id", "key", "path", bands).withColumn("path", F.col("path") * (RADIUS + 1) + F.col("band"))
        mask = F.element_at(F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks]), F.col("path") + 1)
        rows = materialize(rows.select("fp", "id", "path", F.xxhash64("key", "path", F.col("fp").bitwiseAND(mask)).alias("key")), "simhash-shards")
        counts = rows.groupBy("key").agg(F.count("*").alias("n"))
        last = level == LEVELS - 1
        large = materialize(counts.where(F.lit(not last) & (F.col("n") > shard)).select("key"), "simhash-large")
        small = rows.join(large, "key", "left_anti")
        tasks = max(2 * partitions(rows.sparkSession), -(-rows.count() // TASK_ROWS))
        small = small.withColumn("task", F.pmod(F.xxhash64(F.lit(10), "key"), F.lit(tasks)).cast("int"))
        found = small.select("task", "key", "fp", "id").groupBy("task").applyInPandas(shard_links, "a bigint, b bigint")
        links = materialize(found.distinct(), "simhash-links") if links is None else links.union(materialize(found.distinct(), "simhash-links"))
        rows = rows.join(large, "key", "left_semi").select("fp", "id", "path", "key")
        if last or large.isEmpty():
            return links
    raise AssertionError


def near_groups(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle: int = 3, digest: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) per row; with ``digest`` also that of the text."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, digest), "simhash-rows")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    part = components(near_links(distinct.select("fp", F.col("fp").alias("id"))))
    named = distinct.join(part, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("part"))
    named = materialize(named, "simhash-named")
    least = named.groupBy("part").agg(F.min("id").alias("component_id"))
    placed = materialize(named.join(least, "part").select("fp", "component_id"), "simhash-placed")
    return rows.join(placed, "fp").select("doc_id", "fp", "component_id", *(["digest"] if digest else []))


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group, those with the smallest id (rows with a null id stay only if no
    row of their group has one). Rows repeated with that id all stay; exact deduplication is another operator's.

    Rows that go are known by id and text's digest, which settles the fingerprint and spares computing it again."""
    found = materialize(near_groups(docs, id_col=id_col, text_col=text_col, digest=True), "simhash-found")
    gone = found.where("NOT doc_id <=> component_id").select(F.col("doc_id").alias(f"{P}d"), F.col("digest").alias(f"{P}g")).distinct()
    keyed = docs.withColumn(f"{P}h", text_digest(text_col))
    match = keyed[id_col].eqNullSafe(gone[f"{P}d"]) & (keyed[f"{P}h"] == gone[f"{P}g"])
    return keyed.join(gone, match, "left_anti").select(*docs.columns)
