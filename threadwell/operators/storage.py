"""Places for intermediate tables and stream state that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "threadwell-checkpoints")
    return f"{base}/threadwell-engine/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the application's folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    fs, at = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that is there whole or not at all; it must not be there before."""
    fs, at = _file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise FileExistsError(f"{path} was written by another process")


def move(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder new in the place of path."""
    old = f"{path}.{uuid.uuid4().hex}.old"
    fs, at = _file_system(spark, path)
    p = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(at):
        fs.rename(at, p(old))
    fs.rename(p(new), at)
    fs.delete(p(old), True)


def swap(spark: SparkSession, df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace the table at path by df, which may read it: written beside it first, so a failure leaves the old one."""
    new = f"{path}.{uuid.uuid4().hex}.new"
    df.write.partitionBy(*partition_by).parquet(new)
    move(spark, new, path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once its results are written."""
    delete(spark, scratch_root(spark))
