"""Operator 4: pack documents into sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised and packed where they lie, without a shuffle: a task gathers blocks of about ``BLOCK_IDS`` ids. In a
block every document is cut into full windows and one remainder. The remainders are the items: each starts as a partial
partition of its own, and the two partial partitions with the largest differences are merged with opposing imbalances, the
largest windows of one meeting the smallest of the other, until one partition into k near-equal windows is left. If a
window exceeds the capacity, k rises by one, the surplus of each window that is too long is cut off its longest item
(pieces may be cut freely) and becomes items of its own, and the differencing runs again over all items. So every window is
one of a differencing, and none is changed after it. A window whose length is a power of two needs no padding.

A block holds neighbours of the input, whatever their ids, so equal ids or texts make no group of their own. Tables of
many small partitions are coalesced first, by the size that the planner knows, to keep blocks whole.

Defined cases: null or empty text is the end id alone; a text longer than a window fills several; repeated rows are
packed one by one; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.tokens import default_vocabulary, encode_batches, encoder, wide

#: Ids of a block; the last block of a task may have fewer.
BLOCK_IDS = 1 << 20
#: Bytes of the input, as the planner knows them, that a task gets at least.
TASK_BYTES = 1 << 20
#: A surplus above this length is cut in two.
WHOLE = 64


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Items of each of k windows. A partial partition is its non-empty windows in descending order of size. A window is a
    number: an item's, or that of the union of two windows, so merging costs nothing for the items inside."""
    n = len(sizes)
    if not n:
        return []
    heap = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    left: list[int] = []
    right: list[int] = []
    stamp = n
    while len(heap) > 1:
        _, _, sa, ga = heapq.heappop(heap)
        _, _, sb, gb = heapq.heappop(heap)
        both = len(sa) + len(sb) - k
        if both > 0:  # the smallest windows of one meet the largest that have no empty window left to meet
            keep_a, keep_b = len(sa) - both, len(sb) - both
            made = np.arange(n + len(left), n + len(left) + both)
            left += ga[keep_a:].tolist()
            right += gb[keep_b:][::-1].tolist()
            sums = np.concatenate([sa[:keep_a], sb[:keep_b], sa[keep_a:] + sb[keep_b:][::-1]])
            groups = np.concatenate([ga[:keep_a], gb[:keep_b], made])
        else:
            sums, groups = np.concatenate([sa, sb]), np.concatenate([ga, gb])
        order = (-sums).argsort(kind="stable")
        sums, groups = sums[order], groups[order]
        least = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (least - int(sums[0]), stamp, sums, groups))
        stamp += 1
    window = [-1] * (n + len(left))
    last = heap[0][3].tolist()
    for w, g in enumerate(last):
        window[g] = w
    for u in range(len(left) - 1, -1, -1):  # a union is made after its parts
        window[left[u]] = window[right[u]] = window[n + u]
    out: list[list[int]] = [[] for _ in last]
    for i in range(n):
        out[window[i]].append(i)
    return out


def pack_block(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows, each a list of pieces (document, start, length); every id of every document is in exactly one piece."""
    windows: list[list[tuple[int, int, int]]] = []
    items: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n // capacity
        windows += [[(d, i * capacity, capacity)] for i in range(whole)]
        if n > whole * capacity:
            items.append((d, whole * capacity, n - whole * capacity))
    if not items:
        return windows
    k = -(-sum(x[2] for x in items) // capacity)
    while True:
        groups = [[items[i] for i in g] for g in differencing([x[2] for x in items], k)]
        over = [sum(x[2] for x in g) - capacity for g in groups]
        if max(over) <= 0:
            break
        k += 1
        for g, extra in zip(groups, over):
            if extra > 0:
                at = max(range(len(g)), key=lambda i: g[i][2])
                d, start, n = g[at]
                cut = min(extra, n - 1)
                parts = [n - cut, cut] if cut <= WHOLE else [n - cut, cut // 2, cut - cut // 2]
                g[at : at + 1] = [(d, start + sum(parts[:i]), m) for i, m in enumerate(parts) if m]
        items = [x for g in groups for x in g]
    return windows + [_joined(g) for g in groups if g]


def _joined(window: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces in order, neighbours of one document as one piece."""
    out: list[tuple[int, int, int]] = []
    for d, start, n in sorted(window):
        if out and out[-1][0] == d and out[-1][1] + out[-1][2] == start:
            out[-1] = (d, out[-1][1], out[-1][2] + n)
        else:
            out.append((d, start, n))
    return out


def _pack(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, end_id: int, capacity: int, name: str, kind: str, make) -> DataFrame:
    """Pieces, with the column ``name`` made of each piece's ids (bytes) and their width."""
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())

    def block(doc_ids: list, ids: list[bytes], width: int, first: int) -> tuple[pa.RecordBatch, int]:
        lengths = [len(x) // width for x in ids]
        rows, s = [], first
        for w in pack_block(lengths, capacity):
            at = 0
            for d, start, n in w:
                rows.append((doc_ids[d], start, n, make(ids[d][start * width : (start + n) * width], width), lengths[d], s, at))
                at += n
            s += 1
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary() if kind == "binary" else pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", name, "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names), s

    def packed(batches):
        width, held, doc_ids, ids = encoder(vocabulary).width, 0, [], []
        first = TaskContext.get().partitionId() << 40
        for batch in encode_batches(batches, vocabulary, end_id):
            for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                doc_ids.append(d)
                ids.append(x)
                held += len(x) // width
                if held >= BLOCK_IDS:
                    out, first = block(doc_ids, ids, width, first)
                    held, doc_ids, ids = 0, [], []
                    yield out
        if ids:
            yield block(doc_ids, ids, width, first)[0]

    schema = f"doc_id bigint, start bigint, length bigint, {name} {kind}, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.coalesce(min(1 << 30, max(1, known // TASK_BYTES))).mapInArrow(packed, schema)


def pack(docs: DataFrame, *, id_col="doc_id", text_col="text", vocabulary: str | None = None, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (the piece's, little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset in the sequence."""
    return _pack(docs, id_col, text_col, vocabulary, end_id, capacity, "ids", "binary", wide)


def pack_digests(docs: DataFrame, *, id_col="doc_id", text_col="text", vocabulary: str | None = None, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """The same pieces with ids_crc32, of the ids that :func:`pack` returns, in the place of ids."""
    return _pack(docs, id_col, text_col, vocabulary, end_id, capacity, "ids_crc32", "bigint", lambda ids, width: zlib.crc32(wide(ids, width)))
