"""Intermediate results on the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterable

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that a join sends to every executor.
FEW = 100_000
_OWN: dict[str, str] = {}
_USED: dict[str, SparkSession] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder on a local master and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        key = spark.sparkContext.applicationId
        if key not in _OWN:
            _OWN[key] = tempfile.mkdtemp(prefix="concordia-")
            spark.sparkContext.setCheckpointDir(_OWN[key])
        base = _OWN[key]
    return base.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """Where everything that this application stages is; deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/concordia/{spark.sparkContext.applicationId}"
    if path not in _USED:
        _USED[path] = spark
        atexit.register(_remove_quietly, spark, path)
    return path


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """*df* written to the shared folder and read back: later plans start from files, not from its lineage."""
    path = fresh_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def joined(rows: DataFrame, keyed: DataFrame, on: str | list[str]) -> DataFrame:
    """*rows* joined with a staged table, which is broadcast if it has FEW rows at most, counted from its files.

    The planner would go by the size of files: those of a sorted table are a hundredth of it, and it would send millions of
    rows through the driver.
    """
    return rows.join(F.broadcast(keyed), on) if keyed.count() <= FEW else rows.hint("merge").join(keyed, on)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of *path*, local ones without checksum files, and the path in it."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    checked = is_instance_of(spark.sparkContext._gateway, fs, "org.apache.hadoop.fs.ChecksumFileSystem")
    return (fs.getRawFileSystem() if checked else fs), to


def remove(spark: SparkSession, path: str) -> None:
    fs, to = file_system(spark, path)
    fs.delete(to, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, to = file_system(spark, path)
    return fs.exists(to)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder in order of name, or the file itself."""
    fs, to = file_system(spark, path)
    found = sorted(str(f.getPath()) for f in fs.listStatus(to) if f.isFile())
    return [f for f in found if f.rsplit("/", 1)[-1][0] not in "._"]


def write_file(spark: SparkSession, path: str, chunks: Iterable[bytes], parts: Iterable[str] = ()) -> None:
    """One file of *chunks* and then of the files *parts*, which the driver's JVM copies as streams."""
    fs, to = file_system(spark, path)
    out = fs.create(to, True)
    try:
        for chunk in chunks:
            out.write(chunk)
        for part in parts:
            source = file_system(spark, part)
            stream = source[0].open(source[1])
            spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
    finally:
        out.close()


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that no plan will read again."""
    if (path := _PATHS.pop(df, None)) is not None:
        remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete everything this application has staged; results that still read it become unusable."""
    remove(spark, application_folder(spark))


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session ended first
        pass
