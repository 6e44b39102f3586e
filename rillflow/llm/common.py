"""What the operators share: the shared folder, written intermediate tables, file access from tasks."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
MOST_BROADCAST_BYTES = 64 << 20
SALTS = 16
#: Removes the shuffle files of an execution at its end; without it they stay until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Schemes of Hadoop's file systems that pyarrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _free_at_once() -> None:
    """Gives freed arrays of a Python worker back to the system: workers live through many tasks."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        for option, value in ((-3, 1 << 20), (-1, 4 << 20), (-8, 1)):  # mmap threshold, trim threshold, arenas
            libc.mallopt(option, value)
        pa.set_memory_pool(pa.system_memory_pool())
    except (OSError, AttributeError):  # another C library
        pass


if "pyspark.worker" in sys.modules or "pyspark.daemon" in sys.modules:
    _free_at_once()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, in one process, an own one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir isn't set: the executors of a cluster need a folder that all of them share")
        base = "file://" + tempfile.mkdtemp(prefix="rillflow-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/rillflow/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, and survives the loss of any executor.

    What was shuffled for it is of no use then, and its files are removed at once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._rillflow_path = path
    _held(spark).append(path)
    return out


def shipped(spark: SparkSession, value):
    """A broadcast variable for tasks, which release() lets go."""
    out = spark.sparkContext.broadcast(value)
    _held(spark).append(out)
    return out


def _held(spark: SparkSession) -> list:
    sc = spark.sparkContext
    if not hasattr(sc, "_rillflow_held"):
        sc._rillflow_held = []
    return sc._rillflow_held


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(df: DataFrame) -> None:
    """Removes a table that written() made, once nothing reads it any more."""
    if path := getattr(df, "_rillflow_path", None):
        _remove(df.sparkSession, path)


def release(spark: SparkSession, *needed: DataFrame) -> None:
    """Removes the tables and broadcasts that operators made so far, but for the tables that `needed` reads.

    For drivers of several steps: once a step's result is stored, what led to it is of no use. A
    broadcast that is used again after all is sent again.
    """
    held = _held(spark)
    read = [f for df in needed for f in df.inputFiles()] if any(isinstance(x, str) for x in held) else []
    keep = []
    for x in held:
        if not isinstance(x, str):
            x.unpersist()
        elif any(re.sub("^file:/+", "/", x) in f for f in read):
            keep.append(x)
        else:
            _remove(spark, x)
    held[:] = keep


def bounded(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows and MOST_BROADCAST_BYTES bytes, by counting both."""
    fixed, sizes = 0, []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = col_of(f.name)
        if kind in ("string", "binary"):
            sizes.append(F.octet_length(c))
        elif kind in ("array", "map", "struct"):
            sizes.append(F.octet_length(F.to_json(F.struct(c))))
        fixed += 16
    own = [F.sum(F.coalesce(x, F.lit(0))) for x in sizes]
    n, *more = df.agg(F.count(F.lit(1)), *own).first()
    return n <= most and n * fixed + sum(x or 0 for x in more) <= MOST_BROADCAST_BYTES


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """A broadcast hint only where the counted rows and bytes are within their bounds; else Spark's shuffled join."""
    return F.broadcast(df) if bounded(df, most) else df


def join_known(left: DataFrame, right: DataFrame, on: list[str], most: int, how: str = "inner") -> DataFrame:
    """left joined with right by the columns `on`, however often one of their values is in left.

    Within the bounds right is broadcast; beyond, left's rows of a value are dealt out over SALTS
    copies of right's. For inner, left, left_semi and left_anti joins.
    """
    if bounded(right, most):
        return left.join(F.broadcast(right), on, how)
    salt = unused_prefix(left, right) + "salt"
    told = [col_of(f.name) for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    salted = left.withColumn(salt, F.pmod(F.xxhash64(*told), F.lit(SALTS)))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*on, salt], how).drop(salt)


def col_of(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused_prefix(*frames: DataFrame) -> str:
    """A prefix that no column of the frames has: for an operator's own columns beside those of its input."""
    prefix, taken = "_", [c.lower() for df in frames for c in df.columns]
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def lower_ascii(col):
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def filesystem(uri: str):
    """(pyarrow file system, path in it) for a folder of the shared store; works on driver and executors."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    if mark and scheme in SCHEMES:
        uri = SCHEMES[scheme] + mark + rest
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per Spark context, for clusters that don't have it on their path.

    Also bounds the bytes of an Arrow batch, of which JVM and worker each hold several, unless the session's
    configuration names a bound: whole texts may be long.
    """
    import os
    import shutil

    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH_BYTES[0]):
        spark.conf.set(*BATCH_BYTES)
    if not getattr(sc, "_rillflow_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(package):
            folder = tempfile.mkdtemp(prefix="rillflow-ship-")
            copy = shutil.copytree(package, f"{folder}/src/rillflow", ignore=shutil.ignore_patterns("__pycache__"))
            sc.addPyFile(shutil.make_archive(f"{folder}/rillflow", "zip", os.path.dirname(copy)))
            shutil.rmtree(f"{folder}/src")
        sc._rillflow_shipped = True
    return spark
