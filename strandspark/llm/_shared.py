"""Shared-folder tables, files and ordinals that the operators in this folder build on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prefix of helper columns, so that they do not meet a column of the input.
P = "__ss_"
#: Names the folder that a local session has set for itself.
_OWN = "STRANDSPARK_TEST_DIR"


def shared_root(spark: SparkSession) -> str:
    """The run's folder under ``spark.checkpoint.dir``. Where that is unset, as in tests, a local session sets its own; a
    cluster's executors would not reach such a folder, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get(_OWN)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = os.environ[_OWN] = tempfile.mkdtemp(prefix="strandspark-")
        spark.sparkContext.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/strandspark-{spark.sparkContext.applicationId}"
    path, fs = _hadoop(spark, root)
    fs.deleteOnExit(path)
    return root


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new empty folder that the driver and every executor reach."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    p, fs = _hadoop(spark, path)
    fs.mkdirs(p)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` with ``text``, whole or not at all; false if it is there already. The file is written under
    another name and linked (local file systems) or renamed (others) to its own, neither of which replaces a file. On a store
    whose rename is not atomic, writers have to be kept apart by other means."""
    p, fs = _hadoop(spark, path)
    if fs.exists(p):
        return False
    fs.mkdirs(p.getParent())
    if str(fs.getScheme()) == "file":
        place = p.toUri().getPath()
        tmp = f"{os.path.dirname(place)}/.{uuid.uuid4().hex}"
        with open(tmp, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(tmp, place)
            return True
        except FileExistsError:
            return False
        except OSError:  # a mount without links: created for itself alone, then written
            try:
                with open(place, "x", encoding="utf-8") as out:
                    out.write(text)
                return True
            except FileExistsError:
                return False
        finally:
            os.remove(tmp)
    q, _ = _hadoop(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(q, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    done = bool(fs.rename(q, p))
    if not done:
        fs.delete(q, False)
    return done


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors,
    and gives the planner exact sizes."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ss_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        if df is not None:
            delete(df.sparkSession, df._ss_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a dense 1-based position over the whole table, without bringing the rows to one task: range-partition,
    number inside each partition, add the rows of the partitions before it."""
    part, at = f"{P}part", f"{P}at"
    ranged = materialize(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn(part, F.spark_partition_id()), "ordinal")
    before = ranged.groupBy(part).count().withColumn(at, F.sum("count").over(Window.orderBy(part)) - F.col("count")).select(part, at)
    numbered = ranged.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return numbered.join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col(at)).drop(part, at)


def range_bounds(df: DataFrame, column: str, n: int) -> list:
    """At most ``n - 1`` cut points of a numeric column by an approximate percentile sketch (bounded size)."""
    if n < 2:
        return []
    row = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10 * n).alias("b")).first()
    return sorted(set(row["b"] or []))


def range_bucket(column: str, bounds: list) -> Column:
    """Number of bounds that are less than or equal to the value; nulls go last."""
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    # a binary search by fold would be interpreted; the bounds are few hundred and size(filter) is linear but cheap
    found = F.size(F.filter(arr, lambda b: b <= F.col(column)))
    return F.when(F.col(column).isNull(), F.lit(len(bounds))).otherwise(found)


# --- files written by executors -------------------------------------------------------------------------------------


def _arrow_fs(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of its own, then move into place: a retried or doubled task leaves one whole file. Where a move
    does not replace a file, the one that an earlier attempt of the task has left is as good and stays."""
    fs, path = _arrow_fs(uri)
    folder, _, name = path.rpartition("/")
    tmp = f"{folder}/_tmp-{uuid.uuid4().hex}-{name}"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    try:
        fs.move(tmp, path)
    except OSError:
        if fs.get_file_info(path).size != len(data):
            raise
        fs.delete_file(tmp)


def read_file(uri: str) -> bytes:
    fs, path = _arrow_fs(uri)
    with fs.open_input_stream(path) as f:
        return f.read()
