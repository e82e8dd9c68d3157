"""Operator 7: token ids in binary files with Elias-Fano document boundaries.

A shard file holds a run of documents in ascending id order: their ids concatenated, two bytes each where the vocabulary
allows, and two Elias-Fano sequences, the documents' end offsets and the document ids less the smallest. An Elias-Fano
sequence keeps the low bits of each value in a packed array and the high bits in unary; a sampled select structure over
the unary part (the position of every 64th one) returns any value without a table of 64-bit offsets. Reading back asks it
for every document's offsets and id, many at a time (:meth:`EliasFano.select_many`).

Layout, little-endian: magic, version, id width, number of documents, of ids, of null ids (at the end), base id, then
the two sequences (each: low bits, universe, three lengths, low words, high words, samples), then the ids.

Documents are tokenised where they lie; only ids are shuffled, to ranges of doc_id whose bounds come from a percentile
sketch. Each file is written under a temporary name in the shared folder and moved into place, so lost executors and
repeated tasks leave whole files.

Defined cases: null or empty text is the end id alone; null ids come last; rows with equal ids are ordered by their
ids' bytes and kept all; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandspark.llm._shared import fresh_dir, materialize, partitions, range_bounds, read_file, write_file
from strandspark.llm.tokens import default_vocabulary, encode_batches, encoder, wide

MAGIC = b"SSEFTOK1"
#: Ids a shard file holds at most, unless one document alone has more.
SHARD_IDS = 16 << 20
SAMPLE = 64
#: Documents that are read back at a time.
TOGETHER = 1 << 16


def _in_byte() -> np.ndarray:
    """Place of the k-th one of each byte; 8 where there is none."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
    out = np.full((256, 8), 8, np.int64)
    row, place = np.nonzero(bits)
    out[row, (np.cumsum(bits, axis=1) - 1)[row, place]] = place
    return out


_IN_BYTE = _in_byte()


class EliasFano:
    """A non-decreasing sequence of unsigned integers; ``select(i)`` returns the i-th."""

    def __init__(self, low_bits: int, n: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.low_bits, self.n, self.low, self.high, self.samples = low_bits, n, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        if low_bits:
            mask = np.uint64((1 << low_bits) - 1)
            shifts = np.arange(low_bits, dtype=np.uint64)
            bits = ((values & mask)[:, None] >> shifts) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(low_bits, n, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Start at the sampled one before i, then scan bytes of the unary part."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bit = at >> 3, at & 7
        word = int(self.high[byte]) >> bit
        while True:
            ones = word.bit_count()
            if left < ones:
                while True:
                    if word & 1:
                        if not left:
                            break
                        left -= 1
                    word >>= 1
                    bit += 1
                break
            left -= ones
            byte, bit = byte + 1, 0
            word = int(self.high[byte])
        high = byte * 8 + bit - i
        low = 0
        if self.low_bits:
            start = i * self.low_bits
            raw = int.from_bytes(self.low[start >> 3 : (start + self.low_bits + 7) >> 3].tobytes(), "little")
            low = (raw >> (start & 7)) & ((1 << self.low_bits) - 1)
        return (high << self.low_bits) | low

    def select_many(self, index: np.ndarray) -> np.ndarray:
        """``select`` of many positions at once: all start at their samples and pass over bytes until they are there."""
        index = np.asarray(index, np.int64)
        at, left = self.samples[index // SAMPLE].astype(np.int64), index % SAMPLE
        byte, word = at >> 3, np.zeros(len(index), np.uint8)
        if len(index):
            word = (self.high[byte] >> (at & 7).astype(np.uint8)) << (at & 7).astype(np.uint8)
        active = np.flatnonzero(left >= np.bitwise_count(word))
        while len(active):
            left[active] -= np.bitwise_count(word[active])
            byte[active] += 1
            word[active] = self.high[byte[active]]
            active = active[left[active] >= np.bitwise_count(word[active])]
        values = (byte * 8 + _IN_BYTE[word, left] - index).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            start = index * self.low_bits
            low = np.concatenate([self.low, np.zeros(9, np.uint8)])
            raw = low[(start >> 3)[:, None] + np.arange(8)].view("<u8")[:, 0] >> (start & 7).astype(np.uint64)
            if self.low_bits > 57:  # a value may reach into a ninth byte
                more = low[(start >> 3) + 8].astype(np.uint64)
                raw |= np.where(start & 7, more << (np.uint64(64) - np.maximum(start & 7, 1).astype(np.uint64)), np.uint64(0))
            values |= raw & np.uint64((1 << self.low_bits) - 1)
        return values

    def tobytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return struct.pack("<BQQQQ", self.low_bits, self.n, *map(len, parts)) + b"".join(parts)

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        low_bits, n, a, b, c = struct.unpack_from("<BQQQQ", data, at)
        at += 33
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data, "<u4", c // 4, at + a + b)
        return cls(low_bits, n, low, high, samples), at + a + b + c


def encode_shard(doc_ids: list, ids: list[bytes], width: int) -> bytes:
    """One file's bytes; ``doc_ids`` ascending with nulls last."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) // width for x in ids])
    gaps = (known.astype(object) - base).astype(np.uint64) if len(known) and int(known[-1]) - base >= 1 << 62 else (known - base).astype(np.uint64)
    head = MAGIC + struct.pack("<IIQQQq", 1, width, len(ids), int(ends[-1]) if len(ids) else 0, len(doc_ids) - len(known), base)
    return head + EliasFano.build(ends).tobytes() + EliasFano.build(gaps).tobytes() + b"".join(ids)


class Shard:
    """A file read back: ``span(i)`` gives a document's first id and end by two selects, ``ids(i)`` its ids."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token shard")
        _, self.width, self.n, self.n_ids, self.nulls, self.base = struct.unpack_from("<IIQQQq", view, 8)
        self.ends, at = EliasFano.read(view, 48)
        self.gaps, at = EliasFano.read(view, at)
        self.payload = view[at:]

    def doc_id(self, i: int) -> int | None:
        return self.base + self.gaps.select(i) if i < self.n - self.nulls else None

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> bytes:
        a, b = self.span(i)
        return bytes(self.payload[a * self.width : b * self.width])


def write_token_files(docs: DataFrame, folder: str, *, id_col="doc_id", text_col="text", vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the files to ``folder`` (any place that all executors reach); returns the manifest, one row per file:
    bucket, seq, file, n_docs, n_ids, first_id (ids in all files before it)."""
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    n = partitions(docs.sparkSession)
    bounds = np.array(range_bounds(docs, "doc_id", min(4096, 2 * n)), np.int64)

    def tokenised(batches):
        for part in encode_batches(batches, vocabulary, end_id):
            doc_id = part.column("doc_id")
            bucket = np.searchsorted(bounds, doc_id.fill_null(0).to_numpy(), side="right").astype("int32")
            bucket[doc_id.is_null().to_numpy(zero_copy_only=False)] = len(bounds)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), doc_id, part.column("ids")], names=["bucket", "doc_id", "ids"])

    def written(batches):
        width = encoder(vocabulary).width
        key, seq, held, doc_ids, ids = None, 0, 0, [], []

        def close() -> pa.RecordBatch:
            name = f"b{key:05d}-{seq:06d}.eftok"
            write_file(f"{folder}/{name}", encode_shard(doc_ids, ids, width))
            row = {"bucket": pa.array([key], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "n_docs": [len(ids)], "n_ids": [held]}
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            for k, d, x in zip(*(b.column(n).to_pylist() for n in ("bucket", "doc_id", "ids"))):
                if ids and (k != key or held + len(x) // width > SHARD_IDS):
                    yield close()
                    seq, held, doc_ids, ids = (seq + 1 if k == key else 0), 0, [], []
                key = int(k)
                doc_ids.append(d)
                ids.append(x)
                held += len(x) // width
        if ids:
            yield close()

    spread = docs.mapInArrow(tokenised, "bucket int, doc_id bigint, ids binary").repartitionById(len(bounds) + 1, F.col("bucket"))
    ordered = spread.sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), "ids")
    manifest = materialize(ordered.mapInArrow(written, "bucket int, seq int, file string, n_docs bigint, n_ids bigint"), "token-manifest")
    per = manifest.groupBy("bucket").agg(F.sum("n_ids").alias("b_ids"))
    per = per.withColumn("b_first", F.sum("b_ids").over(Window.orderBy("bucket")) - F.col("b_ids")).drop("b_ids")
    inside = F.sum("n_ids").over(Window.partitionBy("bucket").orderBy("seq")) - F.col("n_ids")
    return manifest.withColumn("inside", inside).join(F.broadcast(per), "bucket").withColumn("first_id", F.col("b_first") + F.col("inside")).drop("inside", "b_first")


def read_token_files(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """Read the manifest's files back: doc_id, start, n_tokens, ids_crc32 per document. Offsets and ids come from select."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(b.column("file").to_pylist(), b.column("first_id").to_pylist()):
                s = Shard(read_file(f"{folder}/{name}"))
                for lo in range(0, s.n, TOGETHER):
                    index = np.arange(lo, min(s.n, lo + TOGETHER))
                    ends = s.ends.select_many(index).astype(np.int64)
                    starts = np.concatenate([s.ends.select_many(index[:1] - 1).astype(np.int64) if lo else [0], ends[:-1]])
                    known = index[index < s.n - s.nulls]
                    ids = [s.base + g for g in s.gaps.select_many(known).tolist()] + [None] * (len(index) - len(known))
                    w = s.width
                    crc = [zlib.crc32(wide(s.payload[a * w : e * w], w)) for a, e in zip(starts.tolist(), ends.tolist())]
                    columns = [pa.array(ids, pa.int64()), pa.array(starts + first), pa.array(ends - starts), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "first_id")
    n = max(1, manifest.count())
    # one file a task, so that a lost executor costs little
    files = files.repartitionById(min(n, 10_000), F.pmod(F.xxhash64("file"), F.lit(min(n, 10_000))).cast("int"))
    return files.mapInArrow(decoded, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_offsets(docs: DataFrame, **options) -> DataFrame:
    """Write the documents' token files to a new shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "token-files")
    manifest = materialize(write_token_files(docs, folder, **options), "token-manifest")
    return read_token_files(spark, folder, manifest)
