"""What the operators share: the shared folder, written tables, size-checked joins."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most two longs and a short string that a join may broadcast (some 50 MB); more are shuffled.
BROADCAST_ROWS = 1_000_000
#: A group is hot with over this many rows and over a thousandth of all; parts that a hot group's rows are dealt to.
HOT_ROWS, HOT_GROUPS, SALTS = 1000, 1000, 64
#: Bytes of text that a Python worker works on at once.
SLICE_BYTES = 1_000_000


@functools.cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="skarn-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own, for as long as the application runs, only where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    return (base or _own_dir(spark.sparkContext.applicationId)).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/skarn/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store's name, for libraries other than Spark."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a :func:`written` table that nothing is going to read again."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if "/skarn/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a written ``right`` that is broadcast up to ``rows`` rows, shuffled beyond."""
    small = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right, on, how)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], spread: str | Column, size: str = "size") -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row for each, which counts its rows in ``size``.

    Rows of hot groups are dealt to :data:`SALTS` parts by a hash of ``spread`` (row numbers
    only of a written table, whose rows keep their order when read again), and their
    group's row goes to each of these. Fewer than :data:`HOT_GROUPS` groups can hold over
    that share of all rows, so the broadcast list of hot ones is bounded at any size.
    """
    groups = written(groups, "groups")
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = (F.col(size) > HOT_ROWS) & (F.col(size) * HOT_GROUPS > total)
    listed = groups.where(hot).select(*on, F.lit(True).alias("_hot"))
    salted = groups.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.join(F.broadcast(listed), on, "left").withColumn("_salt", salt).join(salted, [*on, "_salt"]).drop("_hot", "_salt")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def single_rows(docs: DataFrame, repeated: DataFrame, id_: Column, mark: Column) -> DataFrame:
    """``docs`` with one row of each ``_id``, ``_mark`` in the written table ``repeated``; others as they are."""
    if repeated.isEmpty():
        return docs
    keyed = docs.withColumn("_key_id", id_).withColumn("_key_mark", mark)
    on = F.col("_key_id").eqNullSafe(F.col("_id")) & (F.col("_key_mark") == F.col("_mark"))
    once = keyed.join(repeated, on, "left_semi").dropDuplicates(["_key_id", "_key_mark"])
    return keyed.join(repeated, on, "left_anti").unionByName(once).select(*docs.columns)


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most ``most`` bytes of strings, or of one row that alone has more."""
    for b in batches:
        size = np.ones(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(size), 0
        while first < b.num_rows:
            after = max(first + 1, int(np.searchsorted(ends, ends[first] - size[first] + most, "right")))
            yield b.slice(first, after - first)
            first = after


_forget: list[Callable[[], None]] = []


def kept(f: Callable) -> Callable:
    """``f`` with its results kept between the tasks of a Python worker, until :func:`drop_kept`."""
    f = functools.cache(f)
    _forget.append(f.cache_clear)
    return f


def drop_kept() -> None:
    """For the start of a task: a worker that served another operator before lets go of what that one kept."""
    for forget in _forget:
        forget()
    trim()


def trim() -> None:
    """Gives memory that a task has freed back to the machine; workers outlive their tasks."""
    import ctypes
    import ctypes.util

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(ctypes.util.find_library("c") or None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
