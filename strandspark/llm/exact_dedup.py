"""Operator 9: exact duplicates against immutable snapshots screened by static binary fuse filters.

Documents arrive in batches of ascending doc_id; each processed batch is an immutable snapshot. A batch's own duplicates
are grouped by digest first. Every snapshot has, for each shard of the digest space, one static 3-wise binary fuse
filter with 8-bit fingerprints (Graf and Lemire, 2022; about 9 bits a digest), built once from its distinct digests. The
distinct digests of an incoming batch meet the filters of all earlier snapshots shard by shard; only positives join the
snapshots' exact buckets by full digest. Groups of more than one row are then checked by bytes: the least and the
greatest normalised text of a digest must be the same. They are found by a map-side aggregate, so a group of any
size sends one row a task. Digests that fail it are grouped by the text itself.

Defined cases: null text equals empty text and text of white space only equals a single space; null doc_id goes with the
last batch and never is a group's kept row unless all its ids are null; rows repeated with the same id and text count in
group_size, and one of them is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm._shared import P, materialize, range_bounds, range_bucket

BATCHES = 4
#: Distinct digests of one snapshot in one filter, about.
FILTER_KEYS = 400_000


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


# --- the filter -----------------------------------------------------------------------------------------------------


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """MurmurHash3's 64-bit finaliser."""
    h = keys + np.uint64(seed)
    for shift, mult in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mult)
    return h ^ (h >> np.uint64(33))


class BinaryFuse8:
    """A static set of 64-bit keys: no false negatives, about 1 false positive in 256."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    def _slots(self, h: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(self.segment - 1)
        first = ((h >> np.uint64(32)) * np.uint64(self.segments * self.segment)) >> np.uint64(32)
        second = (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        return [x.astype(np.int64) for x in (first, second, third)]

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        segment = 1 << min(18, int(math.floor(math.log(n) / math.log(3.33) + 2.25))) if n > 1 else 4
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) if n > 1 else 2.0
        segments = max(1, -(-int(round(n * factor)) // segment) - 2)
        for seed in range(1, 200):
            self = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if self._fill(keys):
                return self
        raise RuntimeError("no seed gave a peelable filter")

    def _fill(self, keys: np.ndarray) -> bool:
        """Peel keys that are alone in a slot, a round at a time, then assign fingerprints in the reverse order."""
        h = _mixed(keys, self.seed)
        slots = np.stack(self._slots(h), axis=1)
        n, size = len(keys), len(self.table)
        count = np.bincount(slots.ravel(), minlength=size)
        total = np.zeros(size, np.int64)
        np.add.at(total, slots.ravel(), np.repeat(np.arange(n), 3))
        rounds, done = [], 0
        alone = np.flatnonzero(count == 1)
        while len(alone):
            who, at = np.unique(total[alone], return_index=True)
            mine = alone[at]
            rounds.append((who, mine))
            done += len(who)
            touched = slots[who].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(total, touched, np.repeat(who, 3))
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if done < n:
            return False
        prints = self._print(h)
        for who, mine in reversed(rounds):
            s = slots[who]
            value = prints[who] ^ self.table[s[:, 0]] ^ self.table[s[:, 1]] ^ self.table[s[:, 2]]
            self.table[mine] ^= value
        return True

    def __contains__(self, key: int) -> bool:
        return bool(self.may_contain(np.array([key], np.uint64))[0])

    def may_contain(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(np.asarray(keys, np.uint64), self.seed)
        a, b, c = self._slots(h)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == self._print(h)

    def tobytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<u8").tobytes() + self.table.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> BinaryFuse8:
        seed, segment, segments = (int(x) for x in np.frombuffer(data, "<u8", 3))
        return cls(seed, segment, segments, np.frombuffer(data, np.uint8, offset=24))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"snapshot": [pdf["batch"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "filter": [BinaryFuse8.build(pdf["key"].to_numpy(np.int64).view(np.uint64)).tobytes()]})


def _screen(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """(digest, batch, snapshot) for each incoming digest and earlier snapshot whose filter may hold it."""
    out = []
    keys, batch = incoming["key"].to_numpy(np.int64).view(np.uint64), incoming["batch"].to_numpy()
    for snapshot, data in zip(filters["snapshot"], filters["filter"]):
        hit = (batch > snapshot) & BinaryFuse8.frombytes(data).may_contain(keys)
        out.append(pd.DataFrame({"digest": incoming["digest"][hit], "batch": batch[hit], "snapshot": snapshot}))
    return pd.concat(out) if out else pd.DataFrame({"digest": [], "batch": [], "snapshot": []})


# --- the groups -----------------------------------------------------------------------------------------------------


def _groups(units: DataFrame, batches: int) -> DataFrame:
    """(digest, keep_id, group_size) over all batches; ``units``: digest, doc_id, n."""
    bucket = range_bucket("doc_id", range_bounds(units, "doc_id", batches))
    own = units.withColumn("batch", bucket).groupBy("batch", "digest").agg(F.min("doc_id").alias("first_id"), F.sum("n").alias("n"))
    own = materialize(own.withColumn("key", F.xxhash64("digest")), "dedup-batches")
    shards = max(1, -(-own.count() // (batches * FILTER_KEYS)))
    own = own.withColumn("shard", F.pmod(F.xxhash64(F.lit(9), "key"), F.lit(shards)).cast("int"))
    filters = own.select("batch", "shard", "key").groupBy("batch", "shard").applyInPandas(_build, "snapshot int, shard int, filter binary")
    filters = materialize(filters, "dedup-filters")
    incoming = own.where("batch > 0").select("shard", "digest", "key", "batch")
    positive = incoming.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_screen, "digest string, batch int, snapshot int")
    bucketed = own.select(F.col("digest").alias("d"), F.col("batch").alias("b"))
    across = positive.join(bucketed, (F.col("digest") == F.col("d")) & (F.col("snapshot") == F.col("b"))).select("digest").distinct()
    across = materialize(across, "dedup-across")
    rows = own.select("digest", "first_id", "n")
    joined = rows.join(across, "digest", "left_semi").groupBy("digest").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return rows.join(across, "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size")).union(joined)


def duplicate_groups(docs: DataFrame, *, id_col="doc_id", text_col="text", batches: int = BATCHES, digest=sha256) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept. ``digest`` maps normalised text to a string."""
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm")).withColumn("digest", digest(F.col("norm")))
    units = materialize(texts.groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "dedup-units")
    groups = materialize(_groups(units, batches), "dedup-groups")
    # bytes: the hash of a digest is enough to find the texts; what it lets through in excess is checked alike
    many = materialize(groups.where("group_size > 1").select(F.xxhash64("digest").alias("h")).distinct(), "dedup-many")
    copies = texts.join(many, F.xxhash64("digest") == F.col("h"), "left_semi")
    clash = copies.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a <> b").select("digest")
    clash = materialize(clash, "dedup-clash")
    if clash.isEmpty():
        placed = units.join(groups, "digest")
    else:
        same = texts.join(clash, "digest", "left_semi").groupBy("digest", "norm", "doc_id").agg(F.count("*").alias("n"))
        exact = same.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
        clashed = same.join(exact, ["digest", "norm"]).select("digest", "doc_id", "n", "keep_id", "group_size")
        placed = units.join(clash, "digest", "left_anti").join(groups, "digest").select(*clashed.columns).union(clashed)
    first = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias(f"{P}i")
    rows = placed.select("doc_id", "digest", "keep_id", "group_size", first)
    return rows.select("doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col(f"{P}i") == 1)).alias("kept"))


def drop_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", batches: int = BATCHES) -> DataFrame:
    """The rows of ``docs`` that stay, whole."""
    found = materialize(duplicate_groups(docs, id_col=id_col, text_col=text_col, batches=batches), "dedup-rows")
    gone = found.where("NOT doc_id <=> keep_id").select("doc_id", F.xxhash64("digest").alias("h")).distinct()
    keyed = docs.withColumn(f"{P}h", F.xxhash64(sha256(normalised(text_col))))
    gone = gone.select(F.col("doc_id").alias(f"{P}d"), F.col("h").alias(f"{P}g"))
    match = keyed[id_col].eqNullSafe(gone[f"{P}d"]) & (keyed[f"{P}h"] == gone[f"{P}g"])
    left = keyed.join(gone, match, "left_anti")
    again = materialize(found.where("doc_id <=> keep_id AND NOT kept").select(F.col("doc_id").alias(f"{P}d"), F.xxhash64("digest").alias(f"{P}g")).distinct(), "dedup-again")
    if not again.isEmpty():  # rows repeated with the same id: one of them
        match = left[id_col].eqNullSafe(again[f"{P}d"]) & (left[f"{P}h"] == again[f"{P}g"])
        one = left.join(again, match, "left_semi").dropDuplicates([id_col, f"{P}h"])
        left = left.join(again, match, "left_anti").unionByName(one)
    return left.select(*docs.columns)


def digest_rows(docs: DataFrame) -> DataFrame:
    return duplicate_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
