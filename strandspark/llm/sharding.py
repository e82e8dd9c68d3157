"""Operator 8 (native): size-tiered compaction of immutable shards. DataFrame writes only; no row passes Python.

A store is a folder: ``data/`` holds immutable Parquet shards, ``manifest/`` a table of the live ones for each version (file,
shard, bytes, rows, tier, generation), and ``versions/v<version>`` a small file that names the version's table and the rows'
schema, so any driver can open the store. ``append`` writes arrivals as many small shards, as they lie, without a shuffle.
``compact`` groups live shards into tiers by size, each tier ``FAN`` times the one below. A tier with at least ``FAN`` runs is
merged without a shuffle: the reader packs whole files of the tier, largest first, into read partitions of at most the target
size, and each partition becomes one file.

Every change writes a whole new manifest table and then creates the file of the next version, which fails if another
writer was first; readers take the highest version and open the shards that its manifest names. Shards are deleted by
``vacuum`` only, which leaves what a version of the last ``retain_s`` seconds names, so running readers keep their files.
A shard's name is made of the version that added it, its arrival and its number there.

A lost executor costs a task; a lost driver leaves the last committed version and unnamed files, which readers ignore.

Defined cases: rows, nulls, repeats and columns are kept as they are (extra columns too); an empty table commits a
version without shards or with empty ones and reads back empty; a shard above the target is never merged; rows of
another schema than the store's are an error.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandspark.llm._shared import P, claim, delete, discard, fresh_dir, list_names, materialize, read_text

FAN = 4
TARGET_BYTES = 128 << 20
SMALLEST_TIER = 1 << 20
#: Tier of files that are not merged any more.
SETTLED = 99
#: Files that one merge takes at most; the rest of a tier merges in later rounds.
MOST_RUNS = 20_000
#: Folder of the files that one append or merge writes.
RUN = r"g\d{4,}-[0-9a-f]{12}"
ENTRY = "file string, shard string, bytes bigint, rows bigint, tier int, generation int"


class ShardStore:
    """``schema`` is that of the rows: null for a store without a version."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN):
        # a session of its own: the packing of files into read partitions is a session setting
        self.spark = spark.newSession()
        self.root, self.target, self.fan = root.rstrip("/"), target_bytes, fan
        for key, value in {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1", "spark.sql.parquet.compression.codec": "zstd"}.items():
            self.spark.conf.set(key, value)
        versions = self.versions()
        self.schema = self._schema(versions[-1]) if versions else None

    # --- versions ---

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in list_names(self.spark, f"{self.root}/versions") if n.startswith("v"))

    def _version(self, version: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.root}/versions/v{version:08d}"))

    def _schema(self, version: int) -> StructType:
        return StructType.fromJson(self._version(version)["schema"])

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version, the last if none is given."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/manifest/{self._version(version or versions[-1])['manifest']}")

    def commit(self, live: DataFrame, base: int) -> int:
        """Write the whole list, then claim the version after ``base``, which the list was made from."""
        name = f"m-{uuid.uuid4().hex}"
        live.select("file", "shard", "bytes", "rows", "tier", "generation").coalesce(1).write.parquet(f"{self.root}/manifest/{name}")
        version = base + 1
        entry = {"manifest": name, "schema": self.schema.jsonValue(), "time": time.time()}
        if not claim(self.spark, f"{self.root}/versions/v{version:08d}", json.dumps(entry)):
            delete(self.spark, f"{self.root}/manifest/{name}")
            raise RuntimeError(f"another writer committed version {version} first")
        return version

    # --- shards ---

    def _entries(self, folder: str, version: int, generation: int) -> DataFrame:
        """Manifest rows of the files just written to ``folder``; row counts come from footers by a count without columns."""
        files = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/data/{folder}")
        path = F.regexp_extract(F.col("_metadata.file_path"), f"/data/({RUN}/.*)$", 1)
        per = files.groupBy(path.alias("file")).agg(F.max(F.col("_metadata.file_size")).alias("bytes"), F.count("*").alias("rows"))
        arrival = F.regexp_extract("file", f"{P}arrival=(\\d+)/", 1)
        shard = F.format_string("v%06d-%s-%s", F.lit(version), F.when(arrival != "", arrival).otherwise("0"), F.regexp_extract("file", "part-(\\d+)", 1))
        tier = F.when(F.col("bytes") >= self.target * 3 // 4, F.lit(SETTLED)).otherwise(F.floor(F.log(float(self.fan), F.greatest(F.col("bytes") / SMALLEST_TIER, F.lit(1.0))))).cast("int")
        return per.select("file", shard.alias("shard"), "bytes", "rows", tier.alias("tier"), F.lit(generation).alias("generation"))

    def append(self, rows: DataFrame, arrivals: int = 1, by: str | None = None) -> int:
        """Write arrivals (dealt by a hash of ``by``) as small shards and commit them; no shuffle."""
        base = (self.versions() or [0])[-1]
        if self.schema is None:
            self.schema = rows.schema
        if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in self.schema]:
            raise ValueError(f"the store holds rows of {self.schema.simpleString()}, not of {rows.schema.simpleString()}")
        folder = f"g0000-{uuid.uuid4().hex[:12]}"
        if arrivals > 1:
            # one pass: each task writes its rows of every arrival to a file of its own
            dealt = rows.withColumn(f"{P}arrival", F.pmod(F.xxhash64(F.lit(8), by), F.lit(arrivals)).cast("int"))
            dealt.write.option("compression", "zstd").partitionBy(f"{P}arrival").parquet(f"{self.root}/data/{folder}")
        else:
            rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        return self.commit(self.manifest().union(self._entries(folder, base + 1, 0)), base)

    def read(self, version: int | None = None, shard_col: str | None = None) -> DataFrame:
        """The rows of the live shards, which are opened by the paths of the manifest; with ``shard_col`` also the file,
        as the manifest names it."""
        if self.schema is None:
            raise ValueError("the store has no version yet")
        versions = self.versions()
        version = version or versions[-1]
        names = [r["file"] for r in self.manifest(version).select("file").toLocalIterator()]
        reader = self.spark.read.schema(self._schema(version))
        rows = reader.parquet(*[f"{self.root}/data/{n}" for n in names]) if names else self.spark.createDataFrame([], self._schema(version))
        if shard_col is None:
            return rows
        path = F.regexp_extract(F.col("_metadata.file_path"), f"/data/({RUN}/.*)$", 1) if names else F.lit("")
        return rows.select("*", path.alias(shard_col))

    def compact(self) -> int:
        """Merge the lowest tier that has ``fan`` runs, again and again until none has; returns the last version."""
        while True:
            base = (self.versions() or [0])[-1]
            live = self.manifest()
            full = live.where(F.col("tier") < SETTLED).groupBy("tier").count().where(F.col("count") >= self.fan).agg(F.min("tier")).first()[0]
            if full is None:
                return base
            self._merge(live, full, base)

    def _merge(self, live: DataFrame, tier: int, base: int) -> int:
        generation = (live.agg(F.max("generation")).first()[0] or 0) + 1
        # the reader takes paths, so the driver lists them: MOST_RUNS at a time, the rest in later merges
        merged = materialize(live.where(F.col("tier") == tier).orderBy("bytes", "shard", "file").limit(MOST_RUNS).select("file"), "merged")
        names = [r["file"] for r in merged.toLocalIterator()]
        folder = f"g{generation:04d}-{uuid.uuid4().hex[:12]}"
        self.spark.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        source = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{n}" for n in names])
        source.write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        new = self._entries(folder, base + 1, generation)
        # where packing can't halve the number of files any more, they are as large as they get
        if 2 * new.count() > len(names):
            new = new.withColumn("tier", F.lit(SETTLED))
        version = self.commit(live.join(merged, "file", "left_anti").select(*new.columns).union(new), base)
        discard(merged)
        return version

    def vacuum(self, retain_s: float = 7 * 86400.0) -> int:
        """Delete versions older than ``retain_s`` seconds, but never the last, and shards that only they name; returns how
        many versions went. A shard that a writer has not committed yet is in no manifest and is not touched."""
        versions = self.versions()
        old = [v for v in versions[:-1] if self._version(v)["time"] < time.time() - retain_s]
        kept = [v for v in versions if v not in old]
        live = None
        for v in kept if old else []:
            files = self.manifest(v).select("file")
            live = files if live is None else live.union(files)
        gone = None
        for v in old:
            files = self.manifest(v).select("file")
            gone = files if gone is None else gone.union(files)
        if gone is not None:
            for r in gone.distinct().join(live.distinct(), "file", "left_anti").toLocalIterator():
                delete(self.spark, f"{self.root}/data/{r['file']}")
        for v in old:
            name = self._version(v)["manifest"]
            delete(self.spark, f"{self.root}/versions/v{v:08d}")
            delete(self.spark, f"{self.root}/manifest/{name}")
        return len(old)


def shard_documents(docs: DataFrame, *, id_col="doc_id", arrivals: int = 8, target_bytes: int = TARGET_BYTES, root: str | None = None) -> tuple[ShardStore, int]:
    spark = docs.sparkSession
    store = ShardStore(spark, root or fresh_dir(spark, "shards"), target_bytes)
    store.append(docs, arrivals, id_col)
    return store, store.compact()
