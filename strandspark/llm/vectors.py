"""Operator 5: near-duplicate embeddings by hierarchical navigable small-world graphs per shard.

Equal vectors are one class. Classes are dealt by hash to shards, and each shard's task builds one hierarchical navigable
small-world graph (Malkov and Yashunin) and writes it to a file in the shared folder. A vector that is inserted within
half the threshold's angle of a node becomes that node's member instead of a node: any two members of a node are then
linked by the triangle inequality, so a cluster of near copies is one node, whatever its size.

Every block of every shard's nodes is queried against every shard. A query's beam is doubled until its worst entry is
out of reach; past ``WIDEST`` the query is compared with all nodes of the shard in blocks. Each shard's task audits its graph:
queries at the largest angle that has to be found, from stored nodes, have to find them, and the first beam is doubled
until the wanted share does; a graph that can't reach it is searched in full. Found pairs of nodes are verified in
double precision: all members are linked if the angle and both radii say so, none if they rule it out, and else members are
compared with members. A task counts links per vector and returns the linked nodes as a spanning forest, never all pairs.

A shard holds ``SHARD_BYTES`` of vectors at most; the number of shards is ``SHARDS``, more where needed. Each query goes to
every shard, so the work per vector is constant up to ``SHARDS`` * ``SHARD_BYTES`` and grows with the shards beyond.

Defined cases: null, empty or zero vectors and vectors with null or non-finite components link with nothing, nor do
vectors of different lengths; repeated rows count as links of each other; null ids are no smallest id; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm._graph import components
from strandspark.llm._shared import P, discard, fresh_dir, materialize, read_file, write_file

SHARDS = 4
#: Bytes of a shard's vectors in double precision, at most.
SHARD_BYTES = 128 << 20
BLOCK = 1024
#: Queries that walk a graph together.
TOGETHER = 256
#: Blocks of one task and pair of shards.
BLOCKS = 8
AUDIT = 512
RECALL = 0.995
FIRST, WIDEST = 16, 256
#: Radians by which an angle may be off.
SLIP = 2e-6
#: (member, member) pairs that are compared at a time.
PAIRS = 1 << 19


class SmallWorld:
    """Layers of nested node sets, each with a padded neighbour table. Vectors are sorted by their top layer, so that a
    layer's nodes are the first ones; those that come within ``join`` (a cosine) of a node are its members and leave the graph.
    ``order``: the given numbers of the nodes; ``leader``: for each given vector, its node."""

    def __init__(self, x: np.ndarray, join: float, m: int = 16, ef: int = 32, seed: int = 5):
        n = len(x)
        self.m, self.join = m, join + 1e-5  # in single precision
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 12)
        order = np.argsort(-level, kind="stable")
        self.x = np.ascontiguousarray(x[order], np.float32)
        self.of = np.arange(n)  # the node that a vector belongs to; itself where it is a node
        self.layers: list[np.ndarray] = []
        sizes = [int((level >= lv).sum()) for lv in range(int(level.max()) if n else 0, -1, -1)]
        for i, size in enumerate(sizes):
            self.layers.append(np.full((size, 2 * m if i == len(sizes) - 1 else m), -1, np.int32))
            self._build(i, sizes[i - 1] if i else 0, ef)
        # nodes only
        kept = np.flatnonzero(self.of == np.arange(n))
        number = np.full(n + 1, -1, np.int32)
        number[kept] = np.arange(len(kept))
        self.layers = [number[t[kept[kept < len(t)]]] for t in self.layers]
        self.order = order[kept]
        self.leader = np.empty(n, np.int64)
        self.leader[order] = number[self.of]
        self.x = self.x[kept]
        del self.of

    def _build(self, layer: int, old: int, ef: int) -> None:
        """Insert the layer's vectors in batches; the first ``old`` are in a layer above, as nodes or as members."""
        n = len(self.layers[layer])
        done = min(n, 128)
        first = self._nodes(np.arange(done), np.full(done, -1), np.full(done, -9.0), old)
        self._link(layer, first, np.tile(first, (len(first), 1)))
        while done < n:
            new = np.arange(done, min(n, done + max(32, min(512, done // 8))))
            done = int(new[-1]) + 1
            new = new[self.of[new] == new]
            if not len(new):
                continue
            starts = self._descend(self.x[new], layer)
            starts = np.where(starts < new[0], starts, 0)
            found, sims = self._beam(layer, self.x[new], starts, ef, limit=int(new[0]))
            stay = self._nodes(new, found[:, 0], sims[:, 0], old)
            found = found[np.searchsorted(new, stay)]
            if len(stay):
                self._link(layer, stay, np.concatenate([found, np.tile(stay, (len(stay), 1))], axis=1))

    def _nodes(self, new: np.ndarray, nearest: np.ndarray, sim: np.ndarray, old: int) -> np.ndarray:
        """Of new vectors those that become nodes; the others become members of the nearest node, or of a new one."""
        new_ok = self.of[new] == new
        join = new_ok & (new >= old) & (sim >= self.join)
        self.of[new[join]] = nearest[join]
        rest = new[new_ok & ~join]
        near = self.x[rest] @ self.x[rest].T >= self.join
        np.fill_diagonal(near, False)
        for i in np.flatnonzero(near.any(axis=1)):
            if rest[i] >= old and self.of[rest[i]] == rest[i]:
                to = [j for j in np.flatnonzero(near[i, :i]) if self.of[rest[j]] == rest[j]]
                if to:
                    self.of[rest[i]] = rest[to[0]]
        return rest[self.of[rest] == rest]

    def _link(self, layer: int, new: np.ndarray, candidates: np.ndarray) -> None:
        """Diverse neighbours for the new nodes, then the links back."""
        table = self.layers[layer]
        chosen = self._diverse(new, candidates, table.shape[1] // 2)
        table[new, : chosen.shape[1]] = chosen
        src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.lexsort((src, dst))
        src, dst = src[order], dst[order]
        if not len(dst):
            return
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        incoming = np.full((len(to), min(int(count.max()), 96)), -1, np.int64)
        rank = np.arange(len(dst)) - np.repeat(first, count)
        keep = rank < incoming.shape[1]
        incoming[np.repeat(np.arange(len(to)), count)[keep], rank[keep]] = src[keep]
        table[to] = self._pruned(to, np.concatenate([table[to], incoming], axis=1), table.shape[1])

    def _pruned(self, to: np.ndarray, candidates: np.ndarray, width: int) -> np.ndarray:
        have = np.sort(candidates, axis=1)[:, ::-1]
        have = np.where(np.c_[np.zeros(len(to), bool), have[:, 1:] == have[:, :-1]], -1, have)
        few = (have >= 0).sum(axis=1) <= width
        out = np.full((len(to), width), -1, np.int64)
        if few.any():
            out[few] = np.sort(have[few], axis=1)[:, ::-1][:, :width]
        if (~few).any():
            got = self._diverse(to[~few], have[~few], width)
            out[np.flatnonzero(~few)[:, None], np.arange(got.shape[1])] = got
        return out

    def _diverse(self, base: np.ndarray, candidates: np.ndarray, width: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the base than to any chosen one; then fill up."""
        b, c = candidates.shape
        bad = (candidates < 0) | (candidates == base[:, None])
        sim = np.full((b, c), -9.0, np.float32)
        row, col = np.nonzero(~bad)
        sim[row, col] = np.einsum("ed,ed->e", self.x[candidates[row, col]], self.x[base[row]])
        keep = min(c, 3 * width)
        best = np.argpartition(-sim, keep - 1, axis=1)[:, :keep]
        rows = np.arange(b)[:, None]
        best = best[rows, np.argsort(-sim[rows, best], axis=1, kind="stable")]
        sim, cand = sim[rows, best], candidates[rows, best]
        vec = self.x[np.where(sim > -8, cand, 0)]
        between = np.matmul(vec, vec.transpose(0, 2, 1))
        alive, chosen = sim > -8, np.zeros((b, keep), bool)
        count = np.zeros(b, int)
        for j in range(keep):
            take = alive[:, j] & (count < width)
            chosen[take, j] = True
            count += take
            alive &= ~(take[:, None] & (between[:, j] > sim))
            alive[:, j] = False
        rank = np.where(chosen, 0, np.where(sim > -8, 1, 2)) * keep + np.arange(keep)
        best = np.argsort(rank, axis=1)[:, :width]
        return np.where(sim[rows, best] > -8, cand[rows, best], -1)

    def _descend(self, q: np.ndarray, layer: int) -> np.ndarray:
        """Start nodes on ``layer`` by searches from the top."""
        starts = np.zeros(len(q), np.int64)
        for up in range(layer):
            starts = self._beam(up, q, starts, 4)[0][:, 0]
        return starts

    def _beam(self, layer: int, q: np.ndarray, starts: np.ndarray, ef: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ef best nodes found on a layer for each query (padded with -1) and their similarities, best first."""
        table = self.layers[layer]
        b, n = len(q), limit or len(table)
        ef = min(ef, n)
        seen = np.zeros((b, n), bool)
        rows = np.arange(b)
        ids, sims = np.full((b, ef), -1, np.int64), np.full((b, ef), -9.0, np.float32)
        ids[:, 0], sims[:, 0] = starts, np.einsum("bd,bd->b", self.x[starts], q)
        seen[rows, starts] = True
        spent = np.ones((b, ef), bool)
        spent[:, 0] = False
        wide = min(4, ef)
        active = rows
        while len(active):
            score = np.where(spent[active], -9.0, sims[active])
            best = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
            fresh = score[np.arange(len(active))[:, None], best] > -8
            live = fresh.any(axis=1)
            active, best, fresh = active[live], best[live], fresh[live]
            if not len(active):
                break
            spent[active[:, None], best] = True
            near = np.where(fresh[:, :, None], table[np.where(fresh, ids[active[:, None], best], 0)], -1).reshape(len(active), -1)
            if limit:
                near = np.where(near >= n, -1, near)
            near = np.sort(near, axis=1)
            ok = near >= 0
            ok[:, 1:] &= near[:, 1:] != near[:, :-1]
            ok &= ~seen[active[:, None], np.where(ok, near, 0)]
            at, col = np.nonzero(ok)
            node = near[at, col]
            seen[active[at], node] = True
            sim = np.full(near.shape, -9.0, np.float32)
            sim[at, col] = np.einsum("ed,ed->e", self.x[node], q[active[at]])
            all_ids = np.concatenate([ids[active], np.where(ok, near, -1)], axis=1)
            all_sims = np.concatenate([sims[active], sim], axis=1)
            all_spent = np.concatenate([spent[active], ~ok], axis=1)
            order = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ar = np.arange(len(active))[:, None]
            ids[active], sims[active], spent[active] = all_ids[ar, order], all_sims[ar, order], all_spent[ar, order]
        order = np.argsort(-sims, axis=1, kind="stable")
        return ids[rows[:, None], order], sims[rows[:, None], order]

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of the ef best found."""
        q = np.ascontiguousarray(q, np.float32)
        return self._beam(len(self.layers) - 1, q, self._descend(q, len(self.layers) - 1), ef)

    def within(self, q: np.ndarray, least: np.ndarray, ef: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) with a similarity of at least the query's ``least``, nearly. A beam whose worst entry is near
        enough is doubled; past ``WIDEST``, or if ``ef`` is 0, all nodes are compared in blocks."""
        q = np.ascontiguousarray(q, np.float32)
        todo, n = np.arange(len(q)), len(self.x)
        while len(todo) and 0 < ef <= WIDEST:
            again = []
            for at in range(0, len(todo), TOGETHER):
                part = todo[at : at + TOGETHER]
                ids, sims = self.search(q[part], ef)
                wider = (sims[:, -1] >= least[part]) & (ids.shape[1] < n)
                again.append(part[wider])
                r, c = np.nonzero((sims >= least[part][:, None]) & (ids >= 0) & ~wider[:, None])
                yield part[r], ids[r, c]
            todo, ef = np.concatenate(again), 2 * ef
        for at in range(0, len(todo), 256):
            part = todo[at : at + 256]
            for lo in range(0, n, 1 << 14):
                r, c = np.nonzero(q[part] @ self.x[lo : lo + (1 << 14)].T >= least[part][:, None])
                yield part[r], c + lo


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _least(angle: np.ndarray) -> np.ndarray:
    """Similarity in single precision that nothing within the angle falls below."""
    return np.where(angle < np.pi, np.cos(np.minimum(angle, np.pi)), -1.0) - 1e-4


class Shard:
    """A graph with its vectors, sorted by node, in double precision: ``start[i]`` to ``start[i + 1]`` are node i's, the node
    itself first; ``n``: rows of each vector; ``radius``: the largest angle of a node's members."""

    def __init__(self, x: np.ndarray, n: np.ndarray, key: np.ndarray, threshold: float):
        self.threshold, self.theta = threshold, float(np.arccos(threshold))
        self.graph = SmallWorld(x, float(np.cos(max(0.0, self.theta / 2 - SLIP))))
        node = self.graph.leader
        head = np.zeros(len(x), bool)
        head[self.graph.order] = True
        order = np.lexsort((np.arange(len(x)), ~head, node))
        self.x, self.n, self.key, self.node = x[order], n[order], key[order], node[order]
        self.start = np.searchsorted(self.node, np.arange(len(self.graph.x) + 1))
        angle = _angle(np.einsum("ed,ed->e", self.x, self.x[self.start[self.node]]))
        angle[self.start[:-1]] = 0
        self.radius = np.maximum.reduceat(angle, self.start[:-1])
        self.weight = np.add.reduceat(self.n, self.start[:-1])
        self.ef, self.recall = self._audit()

    def _audit(self, seed: int = 3) -> tuple[int, float]:
        """The first beam, and the share of queries that find the node they were made from. Half of the nodes are drawn as
        such and half by their rows; a query lies as far from its node as a link between members of the two can ask, the
        query's radius being another drawn node's (shards are dealt by hash), and is searched for as any query is."""
        nodes, rng = len(self.graph.x), np.random.default_rng(seed)
        drawn = lambda k: np.r_[rng.integers(0, nodes, k // 2), rng.choice(nodes, k // 2, p=self.weight / self.weight.sum())]
        pick, radius = drawn(AUDIT), rng.permutation(self.radius[drawn(AUDIT)])
        base = self.x[self.start[pick]]
        noise = rng.normal(size=base.shape)
        noise -= (noise * base).sum(axis=1, keepdims=True) * base
        norm = np.linalg.norm(noise, axis=1, keepdims=True)
        reach = np.minimum(self.theta + radius + self.radius[pick], np.pi / 2)[:, None]
        q = np.where(norm > 1e-9, np.cos(reach) * base + np.sin(reach) * noise / np.where(norm > 0, norm, 1), base)
        least, ef = _least(self.theta + radius + self.radius.max() + 2 * SLIP), FIRST
        while ef <= WIDEST:
            found = np.zeros(len(pick), bool)
            for a, node in self.graph.within(q, least, ef):
                found[a[node == pick[a]]] = True
            if found.mean() >= RECALL:
                return ef, float(found.mean())
            ef *= 2
        return 0, 1.0

    def members(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nodes' vectors, and for each the place in ``node`` that it comes from."""
        size = self.start[node + 1] - self.start[node]
        of = np.repeat(np.arange(len(node)), size)
        return np.arange(len(of)) + np.repeat(self.start[node] - (np.cumsum(size) - size), size), of


def links(a: Shard, lo: int, hi: int, b: Shard, same: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For the vectors of the nodes ``lo`` to ``hi`` of ``a``: how many rows of ``b`` each is linked to, itself left
    out; and the linked pairs of nodes as a spanning forest of their keys."""
    first = a.start[lo]
    total = np.zeros(a.start[hi] - first, np.int64)
    label: dict[int, int] = {}

    def root(c: int) -> int:
        while label.setdefault(c, c) != c:
            label[c] = label[label[c]]
            c = label[c]
        return c

    def join(x: np.ndarray, y: np.ndarray) -> None:
        for u, v in set(zip(a.key[a.start[x]].tolist(), b.key[b.start[y]].tolist())):
            u, v = root(u), root(v)
            if u != v:
                label[max(u, v)] = min(u, v)

    def add(node: np.ndarray, weight: np.ndarray) -> None:
        """Every member of the nodes gets the weight."""
        at, of = a.members(node)
        np.add.at(total, at - first, weight[of])

    if same:
        node = np.arange(lo, hi)
        add(node, a.weight[node])
        total -= a.n[first : a.start[hi]]
    reach = _least(a.theta + a.radius[lo:hi] + b.radius.max() + 2 * SLIP)
    for q, y in b.graph.within(a.x[a.start[lo:hi]], reach, b.ef):
        x = q + lo
        if same:
            x, y = x[x != y], y[x != y]
        cosine = np.einsum("ed,ed->e", a.x[a.start[x]], b.x[b.start[y]])
        single = (a.radius[x] == 0) & (b.radius[y] == 0) & (a.start[x + 1] - a.start[x] == 1) & (b.start[y + 1] - b.start[y] == 1)
        angle, both = _angle(cosine), a.radius[x] + b.radius[y] + SLIP
        every = np.where(single, cosine >= a.threshold, angle + both <= a.theta)
        add(x[every], b.weight[y[every]])
        join(x[every], y[every])
        some = ~single & ~every & (angle - both <= a.theta)
        x, y = x[some], y[some]
        size_x, size_y = a.start[x + 1] - a.start[x], b.start[y + 1] - b.start[y]
        large = size_x * size_y > PAIRS
        for u, v in zip(x[large], y[large]):
            hit = False
            for i in range(a.start[u], a.start[u + 1], 1024):
                stop = min(i + 1024, a.start[u + 1])
                for j in range(b.start[v], b.start[v + 1], 1 << 14):
                    to = min(j + (1 << 14), b.start[v + 1])
                    near = a.x[i:stop] @ b.x[j:to].T >= a.threshold
                    total[i - first : stop - first] += near @ b.n[j:to]
                    hit |= bool(near.any())
            if hit:
                join(np.array([u]), np.array([v]))
        x, y = x[~large], y[~large]
        cut = np.cumsum(size_x[~large] * size_y[~large])
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(cut, (cut[at - 1] if at else 0) + PAIRS, side="right")))
            i, pair = a.members(x[at:to])
            j, of = b.members(y[at:to][pair])
            i, pair = i[of], pair[of]
            near = np.einsum("ed,ed->e", a.x[i], b.x[j]) >= a.threshold
            np.add.at(total, i[near] - first, b.n[j[near]])
            hit = np.unique(pair[near])
            join(x[at:to][hit], y[at:to][hit])
            at = to
    forest = [(c, root(c)) for c in list(label)]
    return total, [(c, r) for c, r in forest if c != r]


@lru_cache(maxsize=2)
def _shard_file(uri: str) -> Shard:
    return pickle.loads(read_file(uri))


def near_vectors(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", threshold: float = 0.95, shards: int = SHARDS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, classes, built, folder = build_shards(vectors, id_col, vector_col, threshold, shards)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, mine, part, other in zip(batch["dim"], batch["shard"], batch["part"], batch["other"]):
                a, b = _shard_file(f"{folder}/{dim}-{mine}.graph"), _shard_file(f"{folder}/{dim}-{other}.graph")
                nodes = len(a.start) - 1
                for lo in range(part * BLOCKS * BLOCK, min((part + 1) * BLOCKS * BLOCK, nodes), BLOCK):
                    hi = min(lo + BLOCK, nodes)
                    total, forest = links(a, lo, hi, b, mine == other)
                    hit = np.flatnonzero(total)
                    yield pd.DataFrame({"class": a.key[a.start[lo] + hit], "links": total[hit], "other": None}).astype({"other": "Int64"})
                    yield pd.DataFrame({"class": [c for c, _ in forest], "links": 0, "other": [c for _, c in forest]}).astype({"class": "int64", "links": "int64", "other": "Int64"})

    # one row per block of queries and shard: the stated query set in blocks, not rows against rows
    files = built.groupBy("dim", "shard").agg(F.max("nodes").alias("nodes"))
    blocks = files.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("nodes") - 1) / (BLOCK * BLOCKS)).cast("int"))))
    pairs = materialize(blocks.join(files.select("dim", F.col("shard").alias("other")), "dim").select("dim", "shard", "part", "other"), "vec-pairs")
    tasks = max(1, min(20_000, pairs.count()))
    pairs = pairs.repartition(tasks, "dim", "shard", "part", "other").sortWithinPartitions("dim", "other", "shard", "part")
    found = materialize(pairs.mapInPandas(search, "class bigint, links bigint, other bigint"), "vec-found")

    part = components(found.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")))
    node = F.col("leader") == F.col("node")
    placed = built.join(part, node, "left").select("class", F.coalesce("component", "leader").alias("c"))
    named = materialize(classes.select("class", "rep", "n", "h1", "h2").join(placed, "class"), "vec-named")
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    out = named.join(least, "c").join(counts, "class", "left")
    out = materialize(out.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "vec-out")
    joined = rows.select("vec_id", "h1", "h2").join(out, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def build_shards(vectors: DataFrame, id_col="vec_id", vector_col="embedding", threshold: float = 0.95, shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """The rows (vec_id, v, and two hashes that together stand for the vector; null where it links with nothing), the
    classes of equal vectors, the classes' nodes (class, leader) with their shard's number of nodes, first beam and
    audited recall, and the folder of the shards' files."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    valid = F.coalesce(finite & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(valid, F.transform("v", lambda e: e + F.lit(0.0))))
    hashes = {f"h{i}": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(i), "v")) for i in (1, 2)}
    rows = materialize(rows.withColumns(hashes), "vec-rows")
    classes = rows.where("v IS NOT NULL").groupBy("h1", "h2", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    dealt = materialize(classes.withColumn("dim", F.size("v")), "vec-dealt")
    # numbered in a written table, so that a task that runs again gives the same numbers
    classes = materialize(dealt.withColumn("class", F.monotonically_increasing_id()), "vec-classes")
    discard(dealt)
    folder = fresh_dir(spark, "vec-graphs")
    size = classes.groupBy("dim").count().agg(F.max(F.col("count") * F.col("dim") * 8)).first()[0] or 0
    shards = max(shards, -(-size // SHARD_BYTES))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class", kind="stable")
        dim, shard = int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0])
        key = pdf["class"].to_numpy(np.int64)
        made = Shard(_unit(np.stack(pdf["v"].to_numpy())), pdf["n"].to_numpy(np.int64), key, threshold)
        write_file(f"{folder}/{dim}-{shard}.graph", pickle.dumps(made, protocol=5))
        leader = made.key[made.start[made.node]]
        return pd.DataFrame({"dim": dim, "shard": shard, "class": made.key, "leader": leader, "nodes": len(made.start) - 1, "ef": made.ef, "recall": made.recall})

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "h1", "h2"), F.lit(shards)).cast("int")).select("dim", "shard", "class", "n", "v")
    schema = "dim int, shard int, class bigint, leader bigint, nodes bigint, ef int, recall double"
    return rows, classes, materialize(dealt.groupBy("dim", "shard").applyInPandas(build, schema), "vec-shards"), folder
